"""The pipeline stage by stage against plain versions, each on its own input."""

import re
import zlib
from collections import Counter, defaultdict

from .test_operators import SF, WORD, plain_distance


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def plain_contaminated(text, windows):
    """A twentieth of the words or more lie in a window of a benchmark item."""
    words, hit = plain_words(text), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if words[i : i + n] in windows:
                hit.update(range(i, i + n))
    return len(hit) > 0 and 20 * len(hit) >= len(words)


def plain_keep_one(rows):
    """The smallest id of each class of edit similarity 0.8 over words."""
    texts = {r["doc_id"]: WORD.findall(r["text"]) for r in rows if r["text"] is not None}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = texts[a], texts[b]
            long, common = max(len(x), len(y)), sum((Counter(x) & Counter(y)).values())
            if x == y or (long and long - common <= 0.2 * long + 1e-9 and plain_distance(x, y) <= int(0.2 * long + 1e-9)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d for d in ids if find(d) == d} | {r["doc_id"] for r in rows if r["text"] is None}


def test_stages_equal_plain_versions(spark, tmp_path):
    import corpus_pipeline as cp
    from flowlens.llm import rule_quality
    from flowlens.session import read_table

    stage = dict(cp.STAGES)
    docs = read_table(spark, SF, "documents")

    def step(name, df):
        stage[name](spark, df, SF).write.parquet(f"file://{tmp_path}/{name}")
        return spark.read.parquet(f"file://{tmp_path}/{name}")

    good = step("quality", docs)
    scored = rule_quality.score_quality(docs.select("doc_id", "text"), read_table(spark, SF, "labels"))
    fine = {r["doc_id"] for r in scored.where("score >= 0.7").collect()}
    assert rows_of(good) == Counter(tuple(r) for r in docs.collect() if r["doc_id"] in fine)
    labelled = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    lost = [d for d, q in labelled.items() if q == 1 and d not in fine]
    assert len(lost) <= 0.02 * sum(labelled.values())

    single = step("near_dedup", good)
    kept = plain_keep_one(good.collect())
    assert rows_of(single) == Counter(tuple(r) for r in good.collect() if r["doc_id"] in kept)

    clean = step("decontaminate", single)
    windows = set()
    for r in read_table(spark, SF, "benchmark").collect():
        w = plain_words(r["text"])
        windows |= {w[i : i + 13] for i in range(len(w) - 12)} if len(w) >= 13 else {w} - {()}
    assert rows_of(clean) == Counter(tuple(r) for r in single.collect() if not plain_contaminated(r["text"], windows))

    mixed = step("mix", clean)
    own = {r["doc_id"]: r for r in clean.collect()}
    size, taken, cut = defaultdict(int), defaultdict(int), Counter()
    for r in own.values():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in mixed.collect():
        whole = own[r["doc_id"]]
        assert r["lang"] == whole["lang"] and r["source"] == whole["source"]
        words = WORD.findall(r["text"])
        assert words == WORD.findall(whole["text"])[: len(words)]
        taken[r["source"]] += len(words)
        cut[r["source"]] += r["text"] != whole["text"]
    assert max(cut.values()) <= 1 and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 2 * len(size)

    placed = step("shard", mixed).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in placed) == Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in mixed.collect())
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
