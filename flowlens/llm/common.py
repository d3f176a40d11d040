"""Helpers shared by the training-data operators.

Everything here is either a Spark expression or a small per-batch numpy
helper; nothing collects rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import ensure_checkpoint_dir, stored

#: Contract of the learned operators: rows of this remainder are held out.
HELD_OUT_REMAINDER = 2
HELD_OUT_MODULUS = 4

#: Bytes of text a task works on at once, and word bytes hashed at once.
SLICE_BYTES = 2 << 20
HASH_BLOCK = 1 << 20

WHITESPACE_WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows no model may learn from: crc32(id as text) mod 4 = 2.

    A null id is never held out (it has no label to learn from either).
    """
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % HELD_OUT_MODULUS == HELD_OUT_REMAINDER, F.lit(False))


def word_count(text: str | Column) -> Column:
    """Number of whitespace-separated words; null text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WHITESPACE_WORD)), F.lit(0)).cast("bigint")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder.

    The files survive lost executors (never ``localCheckpoint``).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path. Unlike
    after a checkpoint its size is known from the files: loops that join a table
    with itself do not multiply estimates round after round."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` made and no one reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Spark's setting by which the shuffle files of a query go when it has ended.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each step go once it has been run, not when
    the driver happens to collect its garbage. For chains of steps that are each
    cut; should a step be read again all the same, Spark makes its files again."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def shared_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


def numbered(df: DataFrame, row: str, name: str) -> DataFrame:
    """``df`` with a row number in column ``row``, written once to the shared
    folder. The numbers are read, never computed again: a scan that is split
    otherwise (executors lost or gained) would number its rows otherwise."""
    return stored(df.withColumn(row, F.monotonically_increasing_id()), name)


def unique_name(taken: list[str], base: str) -> str:
    """``base``, with underscores added until no input column has that name
    (compared without case, as Spark resolves names)."""
    have = {c.lower() for c in taken}
    while base.lower() in have:
        base = "_" + base
    return base


# ------------------------------------------------------------- byte words ----


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty ranges.

    Zero-copy when the column has no nulls and no slice offset.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, off_buf, data_buf = column.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return data[lo:hi], offsets - lo


def whitespace_table() -> np.ndarray:
    """True for bytes that belong to a word: all but 0x20 and 0x09-0x0D."""
    table = np.ones(256, dtype=bool)
    table[0x20] = False
    table[0x09:0x0E] = False
    return table


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch of documents laid end to end in ``data``.

    Returns (starts, ends, first) where word ``w`` is ``data[starts[w]:ends[w]]``
    and document ``d`` owns words ``first[d]:first[d + 1]``. A word never runs
    across a document boundary.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    begin = np.empty(n, dtype=bool)
    begin[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=begin[1:])
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = inside[inner]
    end = np.empty(n, dtype=bool)
    end[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=end[:-1])
    end[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    first[-1] = len(starts)
    return starts, ends, first


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and xor-shift), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    filled, step = 1, np.uint64(base)
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * step
        filled += take
        step = np.uint64((int(step) * int(step)) & 0xFFFFFFFFFFFFFFFF)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x100000001B3) -> np.ndarray:
    """64-bit hash of every word: a polynomial over its bytes and its length,
    summed with ``add.reduceat`` and then mixed. Works through the bytes in
    blocks, so its memory does not grow with the batch."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), dtype=np.uint64)
    lens = ends - starts
    upto = np.cumsum(lens)
    place = powers(base, int(lens.max()) + 1)
    lo = 0
    while lo < len(starts):
        done = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + HASH_BLOCK, side="right")))
        n = lens[lo:hi]
        first = np.zeros(len(n), np.int64)
        np.cumsum(n[:-1], out=first[1:])
        # position of every byte inside its word
        within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        values = (data[within + np.repeat(starts[lo:hi], n)].astype(np.uint64) + np.uint64(1)) * place[within]
        out[lo:hi] = np.add.reduceat(values, first)
        lo = hi
    return mix64(out + lens.astype(np.uint64) * _ODD)


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) for runs of rows with at most ``max_bytes`` of
    text in all (or one row, if it alone is longer)."""
    data, offsets = string_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def rolling(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` values (mixed, position-aware).

    Prefix polynomial: the run from i has sum(h[i+j] * B**j), taken from
    prefix sums of h[i] * B**i and multiplied by the inverse power B**-i.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = (0x9E3779B97F4A7C15 + 2 * seed * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF | 1
    inverse = pow(base, -1, 1 << 64)
    prefix = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=prefix[1:])
    return mix64((prefix[width:] - prefix[:-width]) * powers(inverse, n))


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Broadcast hint if a count shows at most ``rows`` rows; as is otherwise."""
    return F.broadcast(df) if df.count() <= rows else df
