"""Brute force, round trips, held-out accuracy and edge cases of the
training-data operators on small tables."""

import base64
import hashlib
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_words int, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(vocabulary[int(i)] for i in rng.integers(0, 400, n))
    base, passage = say(120), say(60)
    edited = base.split()
    edited[40] = "changed"
    rows = [
        (1, base, "en", "a", 1, "x"),
        (2, base, "en", "a", 1, "x"),
        (2, base, "en", "a", 1, "x"),
        (3, " ".join(edited), "en", "b", 1, None),
        (4, None, None, None, None, None),
        (5, "", "en", "b", 0, "x"),
        (6, "   ", "de", None, 0, "x"),
        (7, passage + " " + say(30), "de", "c", 2, "x"),
        (8, say(25) + " " + passage, "de", "c", 2, "x"),
        (None, say(90), "de", "c", 2, "x"),
        (10, say(4000), "en", "a", 3, "x"),
        (11, "short one", "en", "d", 3, "x"),
    ]
    path = f"file://{tmp_path_factory.mktemp('odd')}/documents"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('none')}/documents"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------- 1 near-dedup ----


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_equals_full_matrix():
    from flowlens.llm.omh_dedup import edit_distance_within

    rng = np.random.default_rng(1)
    for _ in range(400):
        a = rng.integers(0, 5, rng.integers(0, 25)).astype(np.uint32)
        b = np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 5, rng.integers(0, 6)).astype(np.uint32)])
        d = plain_distance(a, b)
        for most in (0, 1, 3, 30):
            assert edit_distance_within(a, b, most) == (d if d <= most else None)


def test_near_duplicates_on_odd_rows(odd, none):
    from flowlens.llm.omh_dedup import keep_one, near_duplicates

    got = sorted(((r["id"] is None, r["id"] or 0), r["class_id"]) for r in near_duplicates(odd).collect())
    assert [c for _, c in got] == [1, 1, 1, 1, 4, 5, 5, 7, 8, 10, 11, None]
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 7, 8, 10, 11]
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    from flowlens.llm.queries import QUERIES

    texts = {r["doc_id"]: (r["text"] or "").split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = texts[a], texts[b]
            long = max(len(x), len(y))
            if min(len(x), len(y)) < 0.8 * long or len(set(x) & set(y)) < 0.6 * len(set(x)):
                continue
            if 1 - plain_distance(x, y) / long >= 0.8:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert {r["doc_id"]: r["class_id"] for r in QUERIES["op1_order_minhash"](spark, SF).collect()} == {d: find(d) for d in ids}


def test_sketches_meet_at_the_threshold():
    """One changed word in five leaves no common run of five; ten words with one
    changed in the middle leave one."""
    from flowlens.llm.omh_dedup import sketches_of

    rng = np.random.default_rng(4)
    words = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    for n, changed in ((5, [2]), (8, [4]), (10, [5]), (10, [3, 6]), (15, [2, 7, 12]), (100, range(2, 100, 5)), (400, range(2, 400, 5))):
        for _ in range(50):
            a = words(n)
            b = a.copy()
            b[list(changed)] = words(len(changed))
            assert np.intersect1d(sketches_of(a), sketches_of(b)).size, (n, changed)
    for _ in range(50):  # a text of ten words and one of twelve
        a = words(12)
        assert np.intersect1d(sketches_of(a), sketches_of(a[1:11])).size


def test_crowded_bucket_finds_pairs_without_an_end(spark):
    """Hundreds of texts with a common passage of 79 of 100 words; some pairs
    differ in ten words of the rest, spread so that no run outside is common."""
    from flowlens.llm.omh_dedup import near_duplicates

    rng = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(79)]
    tails = [[f"t{d}x{i}" for i in range(21)] for d in range(300)]
    for d in range(0, 40, 2):
        tails[d + 1] = [w if i % 2 else f"o{d}x{i}" for i, w in enumerate(tails[d])]
        tails[d + 1][20] = tails[d][20]
    order = rng.permutation(300)
    rows = [(int(d), " ".join(passage + tails[d])) for d in order]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for group in (4096, 20, 4):  # one group; dealt by words; words dealt in blocks
        got = {r["id"]: r["class_id"] for r in near_duplicates(docs, group=group).collect()}
        assert got == {d: d - d % 2 if d < 40 else d for d in range(300)}


def test_crowded_bucket_writes_no_pairs(spark, monkeypatch):
    """Texts of the same words, 40 of 100 in an order of their own: histograms
    leave room in every pair, only alignments tell them apart."""
    from flowlens.llm import omh_dedup

    rng = np.random.default_rng(3)
    front, back = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(40)]
    texts = [front + [back[i] for i in rng.permutation(40)] for _ in range(200)]
    for d in range(0, 40, 2):  # ten other words: similar to the text before only
        texts[d + 1] = [f"o{d}x{i}" if i >= 90 else w for i, w in enumerate(texts[d])]
    docs = spark.createDataFrame([(int(d), " ".join(texts[d])) for d in rng.permutation(200)], "doc_id long, text string").coalesce(2)
    stored, cut = [], omh_dedup.cut

    def counting(df):
        done = cut(df)
        stored.append(done.count())
        return done

    monkeypatch.setattr(omh_dedup, "cut", counting)
    for group in (4096, 50):  # parts as a whole; a part larger than a group
        stored.clear()
        got = {r["id"]: r["class_id"] for r in omh_dedup.near_duplicates(docs, group=group).collect()}
        assert got == {d: d - d % 2 if d < 40 else d for d in range(200)}
        if group == 4096:
            assert max(stored) <= omh_dedup.SKETCHES * 200  # pairs: 19,900


def test_links_within_equal_brute_force():
    from flowlens.llm.omh_dedup import common_words, links_within, shared_words, similar

    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 9, rng.integers(5, 30)).astype(np.uint32) for _ in range(60)]
    texts += [np.append(t[:-1], np.uint32(50)) for t in texts[:20]]
    for i, common in enumerate(shared_words(texts)):
        assert common.tolist() == [common_words(texts[i], t) for t in texts]
    root = np.arange(80)
    root[5] = 3

    def classes(links):
        part = root.copy()
        for i, j in links:
            part[part == part[j]] = part[i]
        return {frozenset(np.flatnonzero(part == p).tolist()) for p in part}

    links = links_within(texts, root, lambda i: True, lambda i, j: True, 0.8)
    alike = [(i, j) for i in range(80) for j in range(i) if similar(texts[i], texts[j], 0.8)]
    assert classes(links) == classes(alike) and len(links) == 79 - len(classes(alike))


# ------------------------------------------------------------ 2, 6, 10 learned ----


def test_kneser_ney_sums_to_one_and_shares_backoff():
    from flowlens.llm import kn_toxicity as kn

    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, kn.CODES, 5000))
    p = kn.shared_backoff(codes).reshape(-1, kn.LETTERS)
    assert np.allclose(p.sum(1), 1.0)
    table = kn.ratio_table(codes, np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64))
    assert not table.any()  # neither class has counts: only the shared model


def test_learned_operators_on_odd_rows(spark, odd, none):
    from flowlens.llm import bigru_langid, kn_toxicity, rule_quality

    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (7, 1, 1), (8, None, 5), (10, 1, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    for docs, n in ((odd, 12), (none, 0)):
        tox = kn_toxicity.score_toxicity(docs, labels).collect()
        good = rule_quality.score_quality(docs, labels).collect()
        assert len(tox) == len(good) == n
        assert all(0 <= r["score"] <= 1 for r in [*tox, *good])
    assert rule_quality.keep_quality(odd, labels, 0.0).columns == odd.columns
    network = bigru_langid.train_network(odd.where("lang is not null and length(text) > 0"), steps=5)
    said, at = bigru_langid.identify(odd, network)
    rows = {r["doc_id"]: r[at] for r in said.collect()}
    assert rows[4]["lang"] == rows[5]["lang"] == rows[6]["lang"] == "und" and rows[1]["lang"] in ("de", "en")
    assert bigru_langid.identify(odd, None)[0].where(F.col("language.lang") != "und").count() == 0


def test_backpropagation_equals_finite_differences():
    from flowlens.llm.bigru_langid import PAD, Network

    net = Network(["a", "b", "c"], hidden=3, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = np.array([[1, 2], [3, 4], [5, PAD], [7, PAD]])
    y = np.array([0, 2])
    _, grad = net.gradients(x, y)
    for name in net.w:
        flat = net.w[name].reshape(-1)
        spots = np.argsort(-np.abs(grad[name].reshape(-1)))[:3]
        for i in spots:
            old = flat[i]
            flat[i] = old + 1e-3
            up = net.gradients(x, y)[0]
            flat[i] = old - 1e-3
            down = net.gradients(x, y)[0]
            flat[i] = old
            assert abs((up - down) / 2e-3 - grad[name].reshape(-1)[i]) < 1e-3


def test_rules_follow_the_printed_tree():
    from flowlens.llm.rule_quality import simplify, tree_rules

    printed = "    If (feature 3 <= 0.5)\n     If (feature 3 <= 0.2)\n      Predict: 1.0\n     Else (feature 3 > 0.2)\n      Predict: 0.0\n    Else (feature 3 > 0.5)\n     Predict: 0.0"
    assert {simplify(r) for r in tree_rules(printed)} == {
        ((3, False, 0.5),), ((3, False, 0.2),), ((3, False, 0.5), (3, True, 0.2)), ((3, True, 0.5),)
    }


def test_held_out_quality_and_language(spark):
    from flowlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    quality = QUERIES["op6_rule_ensemble_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert quality.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
    language = QUERIES["op10_bigru_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert language.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


# --------------------------------------------------------------------- 3 WARC ----


def test_warc_round_trip(spark, tmp_path):
    from flowlens.llm import warc

    long = "é<p>" + "x" * 700_000
    rows = [(1, "u", "same"), (5, "u", "same"), (3, None, "same"), (2, "u", None), (4, "u", ""), (6, "u\r\nv", long), (None, "u", "none"), (7, "u", "a"), (7, "u", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    pages.write.parquet(f"file://{tmp_path}/pages")
    pages = spark.read.parquet(f"file://{tmp_path}/pages")
    manifest = warc.write_warc(pages, f"file://{tmp_path}/out", file_bytes=1000, chunk_chars=100_000)
    chunks = warc.read_warc(manifest, read_bytes=50_000)
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= 50_000
    parts = chunks.where("headers is null or bytes > 600000").orderBy("chunk").collect()
    assert b"".join(bytes(r["data"]) for r in parts).decode() == long
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.page_records(pages).collect())
    digest = {r["page_id"]: r["payload_digest"] for r in warc.page_records(pages).collect()}
    assert digest[6] == base64.b32encode(hashlib.sha1(long.encode()).digest()).decode()
    n = len(long.encode())
    assert got[:5] == [(0, 4, "response", None), (1, 4, "revisit", 5), (2, 0, "revisit", 4), (3, 4, "revisit", 5), (4, 0, "response", None)]
    assert got[5:7] == [(5, 4, "response", None), (6, n, "response", None)]
    assert sorted(g[2] for g in got[7:]) == ["response", "revisit"]
    assert warc.page_records(pages.where("false")).count() == 0


def test_warc_types_follow_the_data(spark, monkeypatch):
    """Repeated rows, ids with several urls, other splits and clashing names."""
    from flowlens.llm import warc

    monkeypatch.setattr(warc, "COPY_BLOCK", 3)
    rows = [(9, "u", "p")] * 8 + [(9, None, "p"), (9, "v", "p"), (None, "z", "p"), (8, "u", "q")] + [(None, "u", "")] * 2
    extra = ["row", "copy", "sha1", "bytes", "w", "n", "from", "payload", "chunk", "piece", "last_chunk", "record_type"]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("x").alias(c) for c in extra])
    want = sorted([(9, "response", None)] + [(9, "revisit", 9)] * 9 + [(0, "revisit", 9), (8, "response", None), (0, "response", None), (0, "revisit", None)], key=str)
    for parts in (1, 5):
        typed = warc.record_types(pages.repartition(parts))
        assert sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in typed.collect()), key=str) == want
        assert typed.where("record_type = 'response' and page_id = 9").first()["url"] == "v"
        assert typed.select("page_id", "url", "sha1", "copy", "record_type").distinct().count() == len(rows)
    got = warc.page_records(pages).collect()
    assert sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got), key=str) == want


def test_warc_pieces_join_to_the_payload(spark):
    from flowlens.llm import warc

    texts = ["", "a", "\n\r\n", "é\U0001f600" * 7, "x" * 21]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, payload string")
    got = {}
    for r in warc.chunk_rows(rows, 7).orderBy("i", "chunk").collect():
        assert len(r["piece"]) <= 7 and r["chunk"] <= r["last_chunk"]
        got.setdefault(r["i"], []).append(r["piece"])
    assert ["".join(got[i]) for i in range(len(texts))] == texts
    assert [len(got[i]) for i in range(len(texts))] == [1, 1, 1, 2, 3]


# --------------------------------------------------------- 4 decontamination ----


def plain_hits(text, items, size=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in body or ""))
        for p in [w] if 0 < len(w) < size else [w[i : i + size] for i in range(len(w) - size + 1)]:
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("max_words", [2_000_000, 40])
def test_decontamination_equals_brute_force(spark, odd, max_words):
    from flowlens.llm import decontaminate as dc

    docs = {r["doc_id"]: r["text"] for r in odd.collect()}
    items = [(9, " ".join(docs[7].split()[5:30]).upper()), (10, "short ONE!"), (11, None), (12, ""), (13, "w1"), (13, "w2, w3"), (14, "élan")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found, at = dc.find_benchmark(odd, bench, max_words=max_words)
    for r in found.select("doc_id", "text", f"{at}.*", dc.n_hit(at).alias("hit")).collect():
        assert (r["n_words"], r["hit"], sorted(set(r["items"]))) == plain_hits(r["text"], items)
    spans = dc.with_spans(found, "text", at).where("doc_id = 11").first()
    assert [docs[11][s["begin"] : s["end"]] for s in spans["spans"]] == ["short one"]
    assert dc.decontaminate(odd, bench).columns == odd.columns
    assert dc.decontaminate(odd, bench.where("false")).count() == odd.count()


# ------------------------------------------------------------ 5 substring dedup ----


def test_block_dedup_equals_brute_force(spark, odd, none):
    from flowlens.llm.block_dedup import remove_repeats

    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    order = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, float("inf")), order(d))
    want = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < order(d):
                gone[i : i + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((order(d), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for options in ({}, {"bucket_runs": 300}, {"broadcast_rows": 0}):
        got = [(order(r["id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(odd, **options).collect()]
        assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) > 300
    assert remove_repeats(none).count() == 0


# ------------------------------------------------------------- 7, 9 order ----


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 1000])
def test_feistel_is_a_permutation(spark, n):
    from flowlens.llm.feistel import feistel_shards

    df = spark.range(n).withColumn("extra", F.lit(None))
    rows = feistel_shards(df, ["id"], 8).collect()
    assert sorted(r["row_number"] for r in rows) == sorted(r["position"] for r in rows) == list(range(n))
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - n / 8) < 1
    again = feistel_shards(df.repartition(5), ["id"], 8).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_feistel_numbers_repeated_and_null_rows(odd):
    from flowlens.llm.feistel import feistel_shards

    rows = feistel_shards(odd.union(odd), ["doc_id"], 3).collect()
    assert sorted(r["position"] for r in rows) == list(range(24))


def test_fair_mix_targets_and_taken(spark, odd, none):
    from flowlens.llm.fair_mix import fair_mix, mixed_documents
    from flowlens.llm.omh_dedup import keep_one

    rows = fair_mix(odd).collect()
    sizes, targets, taken = {}, {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        targets[r["source"]] = r["target"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, budget, want = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 2 * sizes[s]]
        if not over:
            want.update({s: weight[s] * level for s in left})
            break
        for s in over:
            want[s] = 2 * sizes[s]
            budget -= 2 * sizes[s]
            left.remove(s)
    for s in names:
        assert abs(targets[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 2
    clash = odd.withColumn("mix_row", F.lit("mine")).withColumn("mix_share", F.lit(7)).withColumn("row", F.lit("r"))
    assert {(r["mix_row"], r["mix_share"], r["row"]) for r in mixed_documents(clash).collect()} == {("mine", 7, "r")}
    kept = keep_one(clash).collect()
    assert kept and {(r["mix_row"], r["row"]) for r in kept} == {("mine", "r")}
    mixed = mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == sum(taken.values())
    assert fair_mix(none).count() == 0 and mixed_documents(none).count() == 0


# ------------------------------------------------------------------ 8 top-k ----


def test_voronoi_topk_equals_brute_force(spark):
    from flowlens.llm.voronoi_topk import exact_top_k

    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(6)], "x") for i in range(300)]
    rows += [(300 + i, rows[7][1], "y") for i in range(40)]
    rows += [(400, None, "z"), (401, [1.0, None], "z"), (402, [float("nan")] * 6, "z"), (403, [float("inf")] * 6, "z"), (500, [2.0], "z"), (501, [], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    fine = {i: np.pad(np.floor(1024 * np.array(v)).astype(np.int64), (0, 6 - len(v))) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (x for x in fine if x % 100 == 0):
        best = sorted((-int(fine[q] @ fine[i]), i) for i in fine if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for options in ({}, {"rows_per_pivot": 10, "slice_rows": 16, "query_block": 2}):
        got = exact_top_k(df, F.col("vec_id") % 100 == 0, **options).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert exact_top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


# ------------------------------------------------------- scans split otherwise ----


def test_results_hold_when_a_scan_is_split_otherwise(spark, tmp_path, monkeypatch):
    """As executors come and go the same files are split otherwise, and rows
    get another place in the scan; here after every checkpoint."""
    from flowlens.llm import block_dedup, fair_mix, omh_dedup

    rng = np.random.default_rng(9)
    say = lambda n: " ".join(f"w{int(i)}" for i in rng.integers(0, 500, n))
    passage = say(80)
    rows = [(d, f"{say(30 + d)} {passage if d % 5 == 0 else say(80)} {say(40)}", "en", "abc"[d % 3], 1, "x") for d in range(60)]
    rows += [(100 + d, rows[d][1].replace(" ", " extra ", 1), "en", "a", 1, "x") for d in range(0, 60, 7)]
    path = f"file://{tmp_path}/documents"
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(path)
    operators = {
        "op5": lambda d: block_dedup.remove_repeats(d),
        "op1": lambda d: omh_dedup.near_duplicates(d).select("id", "class_id"),
        "keep": lambda d: omh_dedup.keep_one(d),
        "mix": lambda d: fair_mix.mixed_documents(d),
    }
    want = {k: sorted(map(str, f(spark.read.parquet(path)).collect())) for k, f in operators.items()}
    turn = [0]

    def otherwise(cut):
        def out(df):
            done = cut(df)
            turn[0] += 1
            spark.conf.set("spark.sql.files.minPartitionNum", 1 if turn[0] % 2 else 64)
            return done

        return out

    for module in (block_dedup, omh_dedup, fair_mix):
        monkeypatch.setattr(module, "cut", otherwise(module.cut))
    try:
        for k, f in operators.items():
            spark.conf.set("spark.sql.files.minPartitionNum", 64)
            turn[0] = 0
            assert sorted(map(str, f(spark.read.parquet(path)).collect())) == want[k], k
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


# ----------------------------------------------------------------- pipeline ----


def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert 0 < len(rows) <= 2 * docs.count()
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    crc = {r["text_crc32"] for r in rows}
    known = {zlib.crc32((r["text"] or "").encode()) for r in docs.collect()}
    assert len(crc - known) <= 20  # texts cut at the end of a source's share


def test_toxicity_blocks_equal_the_whole_table(spark):
    from flowlens.llm import kn_toxicity as kn

    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, kn.CODES // 4, 4000))
    toxic, ordinary = rng.integers(0, 4, len(codes)), rng.integers(0, 4, len(codes))
    rows = [(int(c), int(t), int(o)) for c, t, o in zip(codes, toxic, ordinary)]
    counts = spark.createDataFrame(rows, "code int, toxic bigint, ordinary bigint")
    assert (kn.unpacked(kn.gathered_ratios(counts)) == kn.ratio_table(codes, toxic, ordinary)).all()
    assert kn.gathered_ratios(counts.withColumn("toxic", F.lit(0))) is None


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name for d in folders for f in Path(d.toString()).rglob("shuffle_*.data")}


def test_steps_of_near_duplicates_leave_no_shuffle_files(spark, odd):
    """Each step is cut, so its shuffle files go with it and not when the driver
    happens to collect its garbage."""
    from flowlens.llm import omh_dedup
    from flowlens.llm.common import freed_shuffles

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(setting, None), shuffle_files(spark)
    found = omh_dedup.near_duplicates(odd)
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:  # they are removed in the background
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(setting, None) == was
    assert found.count() == found.count() == 12
    with pytest.raises(ValueError), freed_shuffles(spark):
        raise ValueError
    assert spark.conf.get(setting, None) == was


def test_rules_are_fitted_with_few_tasks(spark, monkeypatch):
    """The fit reads its bounded rows a hundred times; a pass has FIT_TASKS tasks
    however many partitions the rows are dealt to."""
    from flowlens.llm import rule_quality

    deal, seen = type(spark.range(0)).repartition, []
    rows = spark.range(400).select("id", F.struct(F.col("id").alias("x")).alias("stats"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    monkeypatch.setattr(rule_quality, "fit_rules", lambda rows, *_: seen.append((rows.rdd.getNumPartitions(), rows.count())))
    learn = lambda: rule_quality.learn_quality(rows.withColumnRenamed("id", "doc_id"), labels, "stats")
    learn()
    monkeypatch.setattr(type(rows), "repartition", lambda self, n, *by: deal(self, 50 if by else n, *by))
    learn()
    kept = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(400))
    assert seen == [(4, kept), (4, kept)]
