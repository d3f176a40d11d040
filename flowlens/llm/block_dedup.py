"""Substring dedup by fixed-block anchors (operator 5).

A window is 50 consecutive words of one document; every word covered by a
window that also occurs in a document with a smaller id is removed.

1. *Anchors.* Each document is cut into non-overlapping reference blocks of 25
   words (positions 0, 25, 50, ...). Any window of 49 words or more contains a
   whole block of whatever document it was copied from.
2. *Probes.* The hash of every rolling run of 25 words, of every document, is
   sent to a bucket named by the hash. In its bucket a probe is a hit if a
   block of a document with another id has the same hash. A probe costs 5
   bytes: 32 bits of hash (the bucket gives further bits) and one byte of
   distance to the probe before it; block or not follows from the position.
3. *Extension.* Only windows that contain a hit can repeat. They are hashed as
   a whole (64 bits beside the bucket's bits) and sent to buckets named by the
   smallest run hash inside them, so neighbouring windows travel together. In
   its bucket each window learns the smallest document id that has it; runs of
   windows with a smaller id are joined to maximal exact repeats.
4. *Removal.* The repeats of a document are merged, their words dropped.

No pair of documents is ever formed: a passage shared by a third of all
documents costs each of them its own probes and windows. Buckets hold about
``BUCKET_RUNS`` runs at any size of the corpus. Text is shuffled only for
documents with hits, then for documents with repeats; the rest is read in
place (which documents: a list broadcast below a checked size, joined beyond).

Exactness: windows are compared by 64 bits plus the bits of the bucket; with
w candidate windows the chance of any false repeat is below w * 2**-43.

Defined cases: a null text has no words; documents shorter than 50 words lose
nothing; a null id counts as larger than all others; rows with one id do not
remove words from each other; equal windows inside one document stay (the
first in id order is the document itself); extra columns are ignored.
Rows are matched across jobs by id and a 64-bit hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut, rolling, small, text_slices, whitespace_table, word_hashes, word_spans

WINDOW = 50
BLOCK = 25
BUCKET_RUNS = 2_000_000
LAST_ID = np.iinfo(np.int64).max
_WORD = whitespace_table()
#: Rows are matched by these two, never by their place in a scan: ``row`` is a
#: 64-bit hash of the text. Documents equal in both lose the same words.
_KEY = ["row", "owner"]
_BUCKETS = "bucket int, ids binary, rows binary, counts binary, gaps binary, hashes binary"


# ------------------------------------------------------------------ packing ----


def pack_gaps(position: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte per entry: the distance to the entry before (``fresh``: from
    -1). 255 stands for 255 more to come and is not an entry. Returns the bytes
    and how many of them each entry took."""
    step = np.empty(len(position), dtype=np.int64)
    if len(position):
        step[0] = position[0] + 1
        step[1:] = np.where(fresh[1:], position[1:] + 1, position[1:] - position[:-1])
    more = step // 255
    used = more + 1
    out = np.full(int(used.sum()), 255, dtype=np.uint8)
    out[np.cumsum(used) - 1] = step % 255
    return out, used


def unpack_gaps(gaps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions again; ``counts`` entries for each document in turn."""
    if len(gaps) == 0:
        return np.zeros(0, np.int64)
    run = np.cumsum(gaps, dtype=np.int64)[gaps != 255]
    last = np.cumsum(counts)
    base = np.zeros(len(counts), dtype=np.int64)
    some = (last > 0) & (np.arange(len(counts)) > 0)
    base[1:] = np.where(last[:-1] > 0, run[np.maximum(last[:-1] - 1, 0)], 0)
    base[~some] = 0
    return run - np.repeat(base, counts) - 1


def pack_buckets(bucket: np.ndarray, owner: np.ndarray, position: np.ndarray, hashes: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
    """One row per bucket; entries are in (owner, position) order already."""
    order = np.argsort(bucket, kind="stable")
    b, o, p, h = bucket[order], owner[order], position[order], hashes[order]
    cuts = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)) if len(b) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        who, at, count = np.unique(o[lo:hi], return_index=True, return_counts=True)
        fresh = np.zeros(hi - lo, dtype=bool)
        fresh[at] = True
        gaps, _ = pack_gaps(p[lo:hi], fresh)
        yield int(b[lo]), ids[who].tobytes(), rows[who].tobytes(), count.astype(np.int32).tobytes(), gaps.tobytes(), h[lo:hi].tobytes()


def unpack_bucket(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, row, position, hash) of all entries of a bucket."""
    ids, rows, spots, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, kind)]
    for i in range(table.num_rows):
        cell = lambda name: table.column(name)[i].as_buffer()  # noqa: B023, E731
        count = np.frombuffer(cell("counts"), dtype=np.int32)
        ids.append(np.repeat(np.frombuffer(cell("ids"), dtype=np.int64), count))
        rows.append(np.repeat(np.frombuffer(cell("rows"), dtype=np.int64), count))
        spots.append(unpack_gaps(np.frombuffer(cell("gaps"), dtype=np.uint8), count))
        hashes.append(np.frombuffer(cell("hashes"), dtype=kind))
    return np.concatenate(ids), np.concatenate(rows), np.concatenate(spots), np.concatenate(hashes)


def _packed_batches(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _BUCKETS.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 5]
    held, size = [], 0
    for row in parts:
        held.append(row)
        size += sum(map(len, row[1:]))
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*held), kinds)], names=names)


def _runs(hashes: np.ndarray, first: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, position) of all runs of ``width`` words that lie in
    one document."""
    h = rolling(hashes, width, seed)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(h)]
    position = np.arange(len(h)) - first[owner]
    inside = np.arange(len(h)) + width <= first[owner + 1]
    return h[inside], owner[inside], position[inside]


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 65536 else np.uint32)


# ------------------------------------------------------------------- stages ----


def probes(docs: DataFrame, buckets: int) -> DataFrame:
    """(row, owner, text) -> packed probes and anchors by bucket."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                rows = batch.column(0).to_numpy(zero_copy_only=False)
                ids = batch.column(1).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
                for lo, hi, data, offsets in text_slices(batch.column(2), 24 << 20):
                    starts, ends, first = word_spans(data, offsets, _WORD)
                    h, owner, position = _runs(word_hashes(data, starts, ends), first, BLOCK, 1)
                    yield from pack_buckets(_bucket_of(h, buckets), owner, position, h.astype(np.uint32), ids[lo:hi], rows[lo:hi])

        yield from _packed_batches(parts())

    return docs.mapInArrow(make, _BUCKETS)


def _extremes(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, smallest id, largest id)."""
    order = np.argsort(key, kind="stable")
    k, i = key[order], ids[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[at], np.minimum.reduceat(i, at), np.maximum.reduceat(i, at)


def hits(packed: DataFrame) -> DataFrame:
    """row, owner, at: positions of runs equal to a block of another id."""

    def find(table: pa.Table) -> pa.Table:
        ids, rows, position, h = unpack_bucket(table, np.uint32)
        block = position % BLOCK == 0
        out_row, out_id, out_at = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if block.any():
            keys, least, most = _extremes(h[block], ids[block])
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = (keys[at] == h) & ((least[at] != ids) | (most[at] != ids))
            out_row, out_id, out_at = rows[hit], ids[hit], position[hit]
        return pa.table({"row": pa.array(out_row), "owner": pa.array(out_id), "at": pa.array(out_at.astype(np.int32))})

    return packed.groupBy("bucket").applyInArrow(find, "row bigint, owner bigint, at int")


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def windows(docs: DataFrame, buckets: int) -> DataFrame:
    """(row, owner, text, at: hit positions) -> packed candidate windows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                rows = batch.column(0).to_numpy(zero_copy_only=False)
                ids = batch.column(1).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
                for lo, hi, data, offsets in text_slices(batch.column(2), 8 << 20):
                    at = batch.column(3).slice(lo, hi - lo)
                    at = at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at
                    spots = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    per_doc = np.diff(at.offsets.to_numpy())
                    starts, ends, first = word_spans(data, offsets, _WORD)
                    words = word_hashes(data, starts, ends)
                    if len(words) < WINDOW or not len(spots):
                        continue
                    # windows that contain a hit: starts in [hit - 25, hit]
                    hit = np.repeat(first[:-1], per_doc) + spots
                    low = np.maximum(hit - (WINDOW - BLOCK), np.repeat(first[:-1], per_doc))
                    cover = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(cover, low, 1)
                    np.add.at(cover, hit + 1, -1)
                    wanted = np.cumsum(cover[:-1]) > 0
                    full = rolling(words, WINDOW, 2)
                    name = _sliding_min(rolling(words, BLOCK, 1), WINDOW - BLOCK + 1)
                    owner = np.repeat(np.arange(hi - lo), np.diff(first))[: len(full)]
                    position = np.arange(len(full)) - first[owner]
                    keep = wanted[: len(full)] & (np.arange(len(full)) + WINDOW <= first[owner + 1])
                    yield from pack_buckets(_bucket_of(name[keep], buckets), owner[keep], position[keep], full[keep], ids[lo:hi], rows[lo:hi])

        yield from _packed_batches(parts())

    return docs.mapInArrow(make, _BUCKETS)


def repeats(packed: DataFrame) -> DataFrame:
    """row, owner, begin, end: word ranges covered by windows of a smaller id."""

    def find(table: pa.Table) -> pa.Table:
        ids, rows, position, h = unpack_bucket(table, np.uint64)
        keys, least, _ = _extremes(h, ids) if len(h) else (h, ids, ids)
        late = least[np.searchsorted(keys, h)] < ids if len(h) else np.zeros(0, bool)
        r, o, p = rows[late], ids[late], position[late]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(r))[: len(begin)] - 1
        return pa.table(
            {"row": pa.array(r[begin]), "owner": pa.array(o[begin]), "begin": pa.array(p[begin].astype(np.int32)), "end": pa.array((p[end] + WINDOW).astype(np.int32))}
        )

    return packed.groupBy("bucket").applyInArrow(find, "row bigint, owner bigint, begin int, end int")


def _clean(docs: DataFrame) -> DataFrame:
    """(id, text, spans) -> id, n_words, n_removed, kept (text)."""
    schema = "id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts, spans = batch.column(1), batch.column(2)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                words = (texts[i].as_py() or "").encode("utf-8").translate(_BLANK).split()
                gone = 0
                if spans[i].is_valid:
                    kept, at = [], 0
                    for s in sorted((x["begin"], x["end"]) for x in spans[i].as_py()):
                        if s[1] <= at:
                            continue
                        begin = max(at, s[0])
                        kept += words[at:begin]
                        gone += s[1] - begin
                        at = s[1]
                    kept += words[at:]
                else:
                    kept = words
                text = b" ".join(kept)
                out.append((doc_id, len(words), gone, text.decode("utf-8"), hashlib.sha256(text).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [c.split()[0] for c in schema.split(", ")]
            for lo in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*out[lo : lo + 1000]), kinds)], names=names)

    return docs.mapInArrow(make, schema)


_BLANK = bytes(32 if not w else i for i, w in enumerate(_WORD))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_runs: int = BUCKET_RUNS, broadcast_rows: int = 1_000_000) -> DataFrame:
    """id, n_words, n_removed, kept, kept_sha256: one row per document."""
    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    base = base.select(F.xxhash64("text").alias("row"), F.coalesce("id", F.lit(int(LAST_ID))).alias("owner"), "id", "text")
    # buckets from the size of the corpus: a word takes about six bytes
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // (6 * bucket_runs)))
    found = cut(hits(probes(base.select(*_KEY, "text"), buckets)).groupBy(*_KEY).agg(F.collect_set("at").alias("at")))
    listed = small(found.select(*_KEY), broadcast_rows)
    texts = base.join(listed, _KEY, "left_semi").join(found, _KEY).select(*_KEY, "text", "at")
    spans = cut(repeats(windows(texts, buckets)).groupBy(*_KEY).agg(F.collect_list(F.struct("begin", "end")).alias("spans")))
    marked = small(spans.select(*_KEY), broadcast_rows)
    whole = base.join(marked, _KEY, "left_anti").select("id", "text", F.lit(None).cast("array<struct<begin:int,end:int>>").alias("spans"))
    changed = base.join(marked, _KEY, "left_semi").join(spans, _KEY).select("id", "text", "spans")
    return _clean(whole.unionByName(changed))
