"""Operators 11 to 13 against plain versions: every distance, every phrase,
every edit script; odd tables."""

import hashlib
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------- 11 centroid clusters ----


def plain_clusters(rows, k, rounds, salt="2", dims=64):
    data = []
    for vec_id, v in rows:
        if v is None or len(v) != dims or any(x is None or not np.isfinite(x) for x in v):
            continue
        data.append((vec_id, [int(np.floor(256.0 * float(x))) for x in v]))
    known = [d for d in data if d[0] is not None]
    start = sorted(known, key=lambda d: (hashlib.sha256(f"{salt}:{d[0]}".encode()).hexdigest(), d[1]))
    start += sorted((d for d in data if d[0] is None), key=lambda d: d[1])
    centroids = [d[1] for d in start[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in data:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, own in groups.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    out = [(vec_id, *nearest(v)[::-1]) for vec_id, v in data]
    inertia = {}
    for _, j, d in out:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in out)


VECTORS = "vec_id long, embedding array<float>, cluster string, v int"


def clustered(spark, rows, **options):
    from flowlens.llm import bisector_kmeans as bk

    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS).repartition(3)
    got, centroids = bk.cluster(df, **options)
    return sorted((str(r["vec_id"]), *list(r)[1:]) for r in got.collect()), centroids


def test_clusters_equal_every_distance(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 4).astype(np.float32).tolist()) for i in range(150)]
    # ties, repeated vectors and ids, odd vectors
    rows += [(200 + i, [0.5, -0.5, 0.0, 0.25]) for i in range(60)] + [(7, [1.0, 0.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0, 0.0]), (None, [0.1] * 4)]
    rows += [(300, None), (301, [1.0]), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan")] * 4), (304, [float("inf"), 0.0, 0.0, 0.0]), (305, [])]
    got, centroids = clustered(spark, rows, k=12, rounds=3, dims=4)
    assert got == plain_clusters(rows, 12, 3, dims=4)
    assert len(centroids) == 12


def test_clusters_of_few_equal_or_no_vectors(spark):
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5])]
    assert clustered(spark, few, k=5, rounds=2, dims=2)[0] == plain_clusters(few, 5, 2, dims=2)
    assert clustered(spark, [(1, None)], k=5, dims=2)[0] == []
    # far components: exact beyond 2**53; beyond MAX_COMPONENT no part
    far = [(i, [200000.0 * (-1) ** i, 100000.0 + i]) for i in range(9)]
    assert clustered(spark, [*far, (99, [1e30, 0.0])], k=3, rounds=2, dims=2)[0] == plain_clusters(far, 3, 2, dims=2)


def test_sign_tests_equal_distances_at_ties():
    from flowlens.llm.bisector_kmeans import Bisectors

    rng = np.random.default_rng(1)
    centroids = rng.integers(-2, 3, (9, 3))
    points = rng.integers(-3, 4, (500, 3))
    number, distance = Bisectors(centroids).winners(points)
    every = ((points[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    with pytest.raises(ValueError):
        Bisectors(np.zeros((5000, 64)))


# ------------------------------------------------------------ 12 license scan ----

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places = []
    for phrase, label in PHRASES.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None,
    "",
    " .,; ",
    "Released under the MIT License.",
    "mit  license MIT-LICENSE, mit license",
    "emit license; mit licenses; émit license; mit license",
    "GNU GENERAL\n\nPUBLIC *** License, version 3. CC BY-NC 4.0 cc-by cc_by ccby",
    "SPDX-License-Identifier: GPL-3.0-or-later and Apache License, Version 2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "the the " * 30000 + "apache license " * 2000,
    "x" * 500000 + " cc by",
    "apache" + " " * 300000 + "license",
]


def test_license_base_phrases_equal_plain(spark):
    from flowlens.llm import license_scan as ls
    from flowlens.llm.queries import QUERIES

    for text in TEXTS:
        raw = (text or "").encode()
        words, found = ls.scan_slice(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        base = [d for d in found.get(0, []) if ls.rules()[d[0]].section == "base"]
        at = [d[1] for d in base]
        got = int(words[0]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({ls.rules()[d[0]].label for d in base}))
        assert got == plain_base(text)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op12_license_rules"](spark, SF).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0.0 <= r["score"] <= 1.0
        assert (r["score"] > 0) == bool(r["labels"])


def test_license_rules_resolve_by_order_and_interval():
    from flowlens.llm import license_scan as ls

    def labels(text):
        raw = text.encode()
        _, found = ls.scan_slice(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return [ls.rules()[d[0]].label for d in found.get(0, [])]

    assert labels("SPDX-License-Identifier: GPL-3.0-or-later") == ["gpl-3.0-or-later"]
    assert labels("under CC BY-NC 4.0.") == ["cc-by", "cc-by-nc-4.0"]
    assert labels("the GNU General Public License, version 2 only") == ["gpl", "gpl-2.0"]
    assert labels("GNU Lesser General Public License v2.1") == ["lgpl-2.1"]
    assert labels("a licence for nothing, submitted by a committee") == []
    # plain containment: drop what lies inside a detection of an earlier rule
    rng = np.random.default_rng(2)
    base = sum(r.section == "base" for r in ls.rules())
    for _ in range(50):
        found = [(int(r), int(a), int(a + n)) for r, a, n in zip(rng.integers(0, 12, 40), rng.integers(0, 30, 40), rng.integers(0, 12, 40))]
        plain = [d for d in found if d[0] < base or not any(e[0] < d[0] and e[1] <= d[1] and d[2] <= e[2] for e in found)]
        assert sorted(ls.resolved(found)) == sorted(plain)


def test_license_prefilter_hides_no_match():
    """Every rule, tried without its gate, finds nothing that lacks its keyword."""
    from flowlens.llm import license_scan as ls
    from flowlens.llm.license_rules import BASE, NOTICES

    assert len(ls.rules()) >= 300 and len(set(ls.rules())) == len(ls.rules())
    for _, keyword, pattern in [*BASE, *(line.split(" | ", 2) for line in NOTICES.strip().splitlines() if not line.startswith("# "))]:
        branches = pattern
        while (m := re.search(r"\(([^()]*)\)(\?|\{0,\d\})?", branches)):
            # optional groups may be absent; of alternatives each must do
            choice = "" if m.group(2) else max(m.group(1).split("|"), key=lambda b: (keyword.strip() not in b, -len(b)))
            branches = branches[: m.start()] + choice + branches[m.end() :]
        assert keyword.strip() in re.sub(r".\?", "", branches.replace("licen[cs]e", "licence")), (keyword, pattern)


def test_license_odd_tables(spark):
    from flowlens.llm import license_scan as ls

    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "MIT License", "b")], "doc_id long, text string, licenses string")
    found, name = ls.find_licenses(df)
    assert name == "_licenses" and found.columns == [*df.columns, name]
    assert sorted((str(r["doc_id"]), len(r[name]["detections"])) for r in found.collect()) == [("1", 0), ("1", 0), ("None", 1)]
    assert ls.find_licenses(df.limit(0))[0].count() == 0


# ----------------------------------------------------- 13 conversation repair ----


def plain_repair(rows):
    """(cost, audit, repaired lines) by comparing whole (cost, audit) pairs."""
    from functools import lru_cache

    onward = {"": "u", "s": "u", "u": "a", "a": "u"}
    n = len(rows)
    sys.setrecursionlimit(20000)

    @lru_cache(None)
    def best(i, last, inserts):
        """Cheapest (cost, audit) of rows i.. after a turn of initial ``last``."""
        options = []
        if i == n and last in ("", "a"):
            options.append((0, ""))
        if inserts < 3:
            c, a = best(i, onward[last], inserts + 1)
            options.append((c + 2, "I" + a))
        if i < n:
            role, _, must, cut = rows[i]
            c, a = best(i + 1, last, 0)
            options.append((c + 3, "D" + a))
            if not must:
                first = role[:1]
                if first == onward[last] or (first == "s" and last == ""):
                    c, a = best(i + 1, first, 0)
                    options.append((c + cut, "K" + a))
                c, a = best(i + 1, onward[last], 0)
                options.append((c + 2 + cut, "R" + a))
        return min(options, default=(1 << 50, ""))

    cost, audit = best(0, "", 0)
    lines, i, last = [], 0, ""
    for letter in audit:
        if letter == "I":
            last = onward[last]
            lines.append({"u": "user:", "a": "assistant:"}[last])
            continue
        role, text, _, _ = rows[i]
        i += 1
        if letter == "K":
            last = role[:1]
            lines.append(f"{role}:{text}")
        elif letter == "R":
            last = onward[last]
            lines.append({"u": "user:", "a": "assistant:"}[last] + text)
    return cost, audit, lines


def plain_conversation(rows):
    """rows (turn, role, text) of one conversation id after damage, in order."""
    seen, judged, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        copy = (role, text) in seen
        seen.add((role, text))
        cut = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        fault = 0 if blank else 1 if copy else 2 if cut else 3
        if fault < 3:
            counts[fault] += 1
        judged.append((role, text, fault < 2, int(fault == 2)))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = plain_repair(judged)
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_table(rows):
    convs = {}
    for conv, turn, role, text in rows:
        key = " " if conv is None else str(conv)
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{key}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest())
    return sorted((str(c), *plain_conversation(sorted(own, key=order))) for c, own in convs.items())


def repaired(df, **options):
    from flowlens.llm import conversation_repair as cr

    report, _ = cr.repair_conversations(df, **options)
    return sorted((str(r["conv_id"]), *list(r)[1:]) for r in report.collect())


@pytest.mark.parametrize("chunk_rows", [1 << 14, 3])
def test_repair_equals_plain_on_the_table(spark, chunk_rows):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    want = plain_table([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert repaired(df, chunk_rows=chunk_rows) == want


def test_repair_of_odd_rows(spark):
    rng = np.random.default_rng(11)
    roles = ["user", "assistant", "system", "tool", "", None, "student", "User"]
    texts = ["Yes.", "No", "", "  ", None, "Why?", "a.b", "é!", "line\nbreak.", "Well."]
    rows = []
    for conv in range(60):
        for turn in rng.integers(0, 40, int(rng.integers(0, 14))).tolist():
            rows.append((conv if conv else None, turn if rng.random() > 0.1 else None, roles[rng.integers(0, len(roles))], texts[rng.integers(0, len(texts))]))
    rows += [(1000, t, "user" if t % 2 else "assistant", "Long. " * 5 + str(t) + ("." if t % 3 else "")) for t in range(700)]
    rows += [(1001, 5, "user", "Same.")] * 300
    rows += [(1002, 1, "user", "x. " * 200000)]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).repartition(5).selectExpr("*", "1 AS rid", "'x' AS chunk", "2 AS place")
    assert repaired(df, chunk_rows=64) == plain_table(rows)
    assert repaired(spark.createDataFrame([], schema)) == []


def test_scripts_do_not_depend_on_blocks():
    from flowlens.llm.conversation_repair import repair

    rng = np.random.default_rng(4)
    for _ in range(60):
        codes = rng.choice([0, 1, 2, 3, 6, 7, 10, 11, 8], int(rng.integers(0, 40))).astype(np.int8)
        whole = repair(codes)
        for block in (1, 2, 7):
            other = repair(codes, block)
            assert whole[0] == other[0] and whole[1] == other[1] and whole[3] == other[3] and (whole[2] == other[2]).all()
        rows = [("xsua"[c & 3], "", bool(c & 4), int(bool(c & 8))) for c in codes.tolist()]
        assert (whole[0], whole[1]) == plain_repair(rows)[:2]


def test_ranks_order_whole_audits():
    """Ranks by doubling against sorted strings, on arcs where a letter can
    lead to several nodes."""
    from flowlens.llm.conversation_repair import audit_ranks

    rng = np.random.default_rng(8)
    for _ in range(40):
        n = int(rng.integers(2, 30))
        arcs = sorted({(int(a), int(b), int(rng.integers(0, 3))) for a, b in (sorted(rng.choice(n, 2, replace=False)) for _ in range(3 * n))})
        least = [""] * n
        for node in range(n - 1, -1, -1):
            own = ["DIKR"[x] + least[b] for a, b, x in arcs if a == node]
            least[node] = min(own, default="")
        columns = [np.array(c) for c in zip(*arcs)]
        rank = audit_ranks(n, *columns)
        for a in range(n):
            for b in range(n):
                assert (least[a] < least[b]) == (rank[a] < rank[b])
