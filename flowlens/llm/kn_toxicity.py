"""Toxicity by class-conditional Kneser-Ney models (operator 2).

Texts become symbols of a 32-letter alphabet (a-z folded from A-Z, digits,
a separator for everything else in ASCII with runs collapsed, four letters for
the last bytes of longer UTF-8 characters). Two interpolated Kneser-Ney models
of order 5, one of toxic and one of ordinary labelled texts, each discount
their own 5-gram counts by one absolute discount (from their counts of counts)
and give the saved mass to *one shared* backoff model: Kneser-Ney continuation
counts of orders 4 to 1, gathered from all documents. A rare expression that a
class has not seen is thus judged by the same backoff in both, and its
log-likelihood ratio is that of the backoff weights alone.

A text is scored by two length-normalised log-likelihood ratios (toxic minus
ordinary, per symbol): over the whole text, and over its strongest stretch of
``STRETCH`` symbols (an insult in a long text is not averaged away). A logistic
regression on a fold of labelled rows the counts did not use turns both into
the score.

Scale: one pass counts 5-grams (compacted per task, then ``groupBy``: the
gathered table covers every document and is stored), one task per first symbol
smooths its block of codes, one pass scores. The alphabet bounds the model:
32**5 codes at most, whatever the corpus; it is broadcast as
compressed float16 blocks (a table of 128 MiB in a worker). The small label
table is broadcast only below ``BROADCAST_ROWS`` rows; beyond, it is joined.

Defined cases: null and empty texts have both ratios 0 and get the score the
regression gives for that; a label null or neither 0 nor 1 is no label; several
label rows of one id: the largest counts; without both classes among the
labelled rows every score is the smoothed share of label 1 (0.5 without rows);
extra columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import cut, held_out, small, text_slices

ORDER = 5
BITS = 5
LETTERS = 1 << BITS
CODES = LETTERS**ORDER
SEPARATOR, DIGIT, WIDE = 26, 27, 28
STRETCH = 16
BROADCAST_ROWS = 1_000_000
CALIBRATION_MODULUS = 4
MERGE_AT = 2_000_000

_FOLD = np.full(256, SEPARATOR, dtype=np.uint8)
for _i in range(26):
    _FOLD[0x41 + _i] = _FOLD[0x61 + _i] = _i
_FOLD[0x30:0x3A] = DIGIT
for _i in range(0x80, 0xC0):
    _FOLD[_i] = WIDE + (_i & 3)
_USED = np.ones(256, dtype=bool)
_USED[0xC0:] = False  # lead bytes: the bytes after them carry the letter


def ngram_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): 5-gram codes of all texts end to end, text ``d`` owns
    ``codes[first[d]:first[d + 1]]``: one per symbol and one for the end."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    keep = _USED[data]
    symbols, doc = _FOLD[data][keep], doc[keep]
    if len(symbols):
        again = np.zeros(len(symbols), dtype=bool)
        again[1:] = (symbols[1:] == SEPARATOR) & (symbols[:-1] == SEPARATOR) & (doc[1:] == doc[:-1])
        symbols, doc = symbols[~again], doc[~again]
    sizes = np.bincount(doc, minlength=n)
    line = np.full(len(symbols) + ORDER * n, SEPARATOR, dtype=np.uint32)
    line[np.arange(len(symbols)) + (ORDER - 1) + ORDER * doc] = symbols
    codes = np.zeros(max(0, len(line) - ORDER + 1), dtype=np.uint32)
    for k in range(ORDER):
        codes <<= np.uint32(BITS)
        codes |= line[k : k + len(codes)]
    # 5-grams that begin in one text and end in the next are dropped
    begin = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    mark = np.ones(len(codes), dtype=bool)
    for k in range(1, ORDER):
        at = begin[1:] - k
        mark[at[at >= 0]] = False
    first = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=first[1:])
    return codes[mark], first


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def count_ngrams(docs: DataFrame, text: str, label: str) -> DataFrame:
    """code, toxic, ordinary: 5-gram counts of the two classes over all texts
    (a row with two zeros: seen in unlabelled texts only)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            kinds = batch.column(1).fill_null(2).to_numpy(zero_copy_only=False).astype(np.uint32)
            for lo, hi, data, offsets in text_slices(batch.column(0)):
                codes, first = ngram_codes(data, offsets)
                keys = (codes << np.uint32(2)) | np.repeat(kinds[lo:hi], np.diff(first))
                parts.append(np.unique(keys, return_counts=True))
                if sum(len(p[0]) for p in parts) > MERGE_AT:
                    parts = [_merge(parts)]
        if parts:
            keys, n = _merge(parts)
            for lo in range(0, len(keys), 100_000):
                k = keys[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((k >> np.uint32(2)).astype(np.int32)), pa.array((k & np.uint32(3)).astype(np.int32)), pa.array(n[lo : lo + 100_000])],
                    names=["code", "kind", "n"],
                )

    raw = docs.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")).mapInArrow(count, "code int, kind int, n bigint")
    pick = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    return raw.groupBy("code").agg(pick(1).alias("toxic"), pick(0).alias("ordinary"))


def shared_backoff(codes: np.ndarray) -> np.ndarray:
    """p(w | 3 symbols) for all 32**4 4-grams, from continuation counts of the
    distinct 5-grams of the whole corpus."""
    return backoff_of(np.bincount(codes & (LETTERS**4 - 1), minlength=LETTERS**4))


def backoff_of(types: np.ndarray) -> np.ndarray:
    """The same from the number of distinct 5-grams that end in each 4-gram."""
    seen, levels = np.flatnonzero(types), [types]
    for order in (3, 2, 1):
        n = np.bincount(seen & (LETTERS**order - 1), minlength=LETTERS**order)
        levels.append(n)
        seen = np.flatnonzero(n)
    p = (levels[-1] + 1.0) / (levels[-1].sum() + LETTERS)
    for n in levels[-2::-1]:
        p = _interpolate(n, p)
    return p


def discount(n: np.ndarray) -> float:
    """Absolute discount n1 / (n1 + 2 n2), kept inside (0, 1)."""
    return discount_of(int((n == 1).sum()), int((n == 2).sum()))


def discount_of(one: int, two: int) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def _interpolate(n: np.ndarray, lower: np.ndarray, d: float | None = None) -> np.ndarray:
    """(max(n - d, 0) + d * types * lower) / total per history; histories never
    seen take the lower order as it is. ``lower`` repeats over first symbols."""
    d = discount(n) if d is None else d
    rows = n.reshape(-1, LETTERS).astype(np.float64)
    low = lower.reshape(-1, LETTERS)
    low = np.broadcast_to(low, (max(1, len(rows) // len(low)), *low.shape)).reshape(-1, LETTERS)
    total = rows.sum(1, keepdims=True)
    types = (rows > 0).sum(1, keepdims=True)
    p = (np.maximum(rows - d, 0) + d * types * low) / np.maximum(total, 1)
    return np.where(total > 0, p, low).ravel()


WIDTH = CODES // LETTERS  # codes of one first symbol, a block


def block_ratios(at: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, lower: np.ndarray, discounts: tuple[float, float]) -> np.ndarray:
    """log p_toxic - log p_ordinary (float16) for the codes of one first symbol;
    ``at`` are the places of the counted codes in the block."""
    logs = []
    for n, disc in zip((toxic, ordinary), discounts):
        dense = np.zeros(WIDTH, dtype=np.int64)
        dense[at] = n
        logs.append(np.log(_interpolate(dense, lower, disc)))
    return (logs[0] - logs[1]).astype(np.float16)


def ratio_table(codes: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log p_toxic - log p_ordinary for every 5-gram code (float16)."""
    lower = shared_backoff(codes)
    d = discount(toxic), discount(ordinary)
    edges = np.searchsorted(codes, np.arange(LETTERS + 1) * WIDTH)
    parts = []
    for block, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        parts.append(block_ratios(codes[lo:hi] - block * WIDTH, toxic[lo:hi], ordinary[lo:hi], lower, d))
    return np.concatenate(parts)


def gathered_ratios(counts: DataFrame) -> dict[int, bytes] | None:
    """``ratio_table`` of a stored count table as compressed blocks (see
    ``unpacked``), None without counts of both classes. Every block of codes is smoothed in a task of its own (at most
    32**4 rows); the driver receives the 4-gram continuation counts (at most
    32**4 rows) and the compressed blocks (less than 64 MiB)."""
    times = lambda c, n: F.sum(F.when(F.col(c) == n, 1).otherwise(0))
    s = counts.agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"),
        *[times(c, n).alias(f"{c}{n}") for c in ("toxic", "ordinary") for n in (1, 2)],
    ).first()
    if not s["toxic"] or not s["ordinary"]:
        return None
    ends = counts.groupBy((F.col("code") % LETTERS**4).alias("end")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    types = np.zeros(LETTERS**4, dtype=np.int64)
    types[ends["end"].to_numpy()] = ends["n"].to_numpy()
    shared = counts.sparkSession.sparkContext.broadcast(backoff_of(types))
    discounts = tuple(discount_of(s[f"{c}1"], s[f"{c}2"]) for c in ("toxic", "ordinary"))

    def smooth(f: pd.DataFrame) -> pd.DataFrame:
        code = f["code"].to_numpy()
        ratios = block_ratios(code % WIDTH, f["toxic"].to_numpy(), f["ordinary"].to_numpy(), shared.value, discounts)
        return pd.DataFrame({"block": [int(code[0]) // WIDTH], "ratios": [zlib.compress(ratios.tobytes(), 1)]})

    block = F.floor(F.col("code") / WIDTH).alias("block")
    return {r["block"]: bytes(r["ratios"]) for r in counts.groupBy(block).applyInPandas(smooth, "block int, ratios binary").collect()}


def unpacked(blocks: dict[int, bytes]) -> np.ndarray:
    """The whole table (float32); in a block never seen both classes back off alike."""
    table = np.zeros(CODES, dtype=np.float32)
    for block, ratios in blocks.items():
        table[block * WIDTH : (block + 1) * WIDTH] = np.frombuffer(zlib.decompress(ratios), dtype=np.float16)
    return table


def evidence(codes: np.ndarray, first: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: mean ratio per symbol over the text and over its strongest
    stretch; 0 for texts without symbols."""
    sizes = np.diff(first)
    run = np.zeros(len(codes) + 1)
    np.cumsum(table[codes], dtype=np.float64, out=run[1:])
    empty = sizes <= 1
    mean = (run[first[1:]] - run[first[:-1]]) / np.maximum(sizes, 1)
    span = np.minimum(sizes, STRETCH)
    best = (run[first[:-1] + span] - run[first[:-1]]) / STRETCH
    if len(codes) > STRETCH:
        windows = run[STRETCH:] - run[:-STRETCH]
        # a stretch must begin early enough to end inside its own text
        last = np.repeat(first[1:] - STRETCH, sizes)[: len(windows)]
        windows[np.arange(len(windows)) > last] = -np.inf
        starts = np.minimum(first[:-1], len(windows) - 1)
        whole = sizes >= STRETCH
        if whole.any():
            tops = np.maximum.reduceat(windows, starts)
            best[whole] = np.maximum(best[whole], tops[whole] / STRETCH)
    mean[empty], best[empty] = 0.0, 0.0
    return mean, best


def with_evidence(docs: DataFrame, blocks: dict[int, bytes], text: str, result: str) -> DataFrame:
    """``docs`` + struct (mean, peak)."""
    shared = docs.sparkSession.sparkContext.broadcast(blocks)
    kind = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("peak", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = unpacked(shared.value)
        for batch in batches:
            means, peaks = [np.zeros(0)], [np.zeros(0)]
            for _, _, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text))):
                m, p = evidence(*ngram_codes(data, offsets), values)
                means.append(m)
                peaks.append(p)
            made = pa.StructArray.from_arrays([pa.array(np.concatenate(means)), pa.array(np.concatenate(peaks))], ["mean", "peak"])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, result])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(result, kind)]))


def logistic(features: DataFrame, columns: list[str], label: str, reg: float = 1e-4) -> Column | None:
    """Logistic regression as a column expression; None without both classes."""
    if features.select(label).distinct().count() < 2:
        return None
    ready = features.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])).alias("features"), F.col(label).cast("double").alias("label"))
    model = LogisticRegression(maxIter=60, regParam=reg, tol=1e-9).fit(ready)
    z = F.lit(float(model.intercept))
    for c, w in zip(columns, model.coefficients):
        z = z + F.col(c) * F.lit(float(w))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, held_out, score, mean, peak per document."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    known = small(known.where(~held_out("id")), broadcast_rows)
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    fold = F.coalesce(F.floor(F.crc32(F.col("id").cast("string")) / 4) % CALIBRATION_MODULUS == 0, F.lit(False))
    marked = base.join(known, "id", "left").select("text", F.when(~fold, F.col("label")).alias("label"))
    blocks = gathered_ratios(cut(count_ngrams(marked, "text", "label")))
    if blocks is None:
        n = labels.where(F.col(label).isin(0, 1) & ~held_out(doc_id)).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("s")).first()
        share = ((n["s"] or 0) + 1.0) / (n["n"] + 2.0)
        return base.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), F.lit(share).alias("score"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("peak"))
    scored = with_evidence(base, blocks, "text", "e")
    scored = cut(scored.select("id", F.col("e.mean").alias("mean"), F.col("e.peak").alias("peak")))
    fit = scored.where(fold).join(known, "id")
    score = logistic(fit, ["mean", "peak"], "label")
    if score is None:  # no calibration rows of both classes: the plain ratio
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("mean")))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), score.alias("score"), "mean", "peak")
