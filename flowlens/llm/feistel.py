"""Sharding by a Feistel permutation with cycle walking (operator 7).

Every row gets a global row number, a keyed permutation maps the number to a
position, and position ``p`` of ``N`` lies in shard ``p mod S`` at slot
``p div S``. The permutation is computable from ``(row_number, N, seed)``
alone, so shard and slot of any row can be recomputed without the data, and
shard sizes differ by at most one row (law ``rows``).

All steps are DataFrame expressions:

* equal rows (equal in every key) are counted first with partial aggregation,
  so a row that makes up a third of the table is one counted row in the
  numbering;
* numbering orders the counted rows by the md5 of their keys. The first three
  hex digits of the md5 are a bucket; a histogram of the ``16**3`` buckets
  gives the offsets and a window inside each bucket gives the rest, so no
  task sorts more than about ``rows / 4096`` rows;
* the Feistel network works on ``Z_a x Z_b`` with ``a*b >= N > a*b - a``: less
  than one value in ``sqrt(N)`` lies outside and is walked on until it falls
  inside. A walk only passes through the fewer than ``a`` outside values and
  is cut with an error after ``MAX_WALK`` steps (never reached in practice;
  for N <= 4096 it cannot be).

Defined cases: an empty table gives an empty result; null keys sort as the
text ``~`` and are counted like any other value; repeated rows get consecutive
row numbers; extra columns are ignored (the result has the keys and the new
columns; a key that has the name of a new column is refused).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME = 2147483647
ROUNDS = 6
MAX_WALK = 64
BUCKET_DIGITS = 3
COPIES_PER_CHUNK = 65_536
NEW_COLUMNS = ("row_number", "position", "shard", "slot")


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """(add, multiply, shift) of each round, derived from the seed by a
    multiplicative congruence modulo the prime 2**31 - 1."""
    x = (int(seed) * 48271 + 11) % PRIME or 1
    out = []
    for _ in range(rounds):
        triple = []
        for _ in range(3):
            x = x * 48271 % PRIME
            triple.append(x)
        out.append(tuple(triple))
    return out


def order_key(keys: Sequence[str]) -> Column:
    """md5 of the keys as text; null is ``~``. Its order is the row order."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys]))


def number_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` + ``row_number`` (0-based, gapless), one row per input row."""
    keys = list(keys)
    slim = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", order_key(keys))
    slim = slim.withColumn("_bucket", F.substring("_k", 1, BUCKET_DIGITS))
    hist = slim.groupBy("_bucket").agg(F.sum("_n").alias("_c"))
    # at most 16**3 rows: bounded by the number of md5 prefixes
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select("_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = (
        Window.partitionBy("_bucket").orderBy("_k", *keys).rowsBetween(Window.unboundedPreceding, -1)
    )
    first = slim.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    first = first.join(F.broadcast(offsets), "_bucket").withColumn("_first", F.col("_off") + F.col("_in"))
    # copies of one row: chunks first, so that no array is longer than a chunk
    chunk = F.lit(COPIES_PER_CHUNK)
    chunks = first.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {COPIES_PER_CHUNK}"))))
    last = F.least(F.col("_n"), (F.col("_chunk") + 1) * chunk) - 1
    copies = chunks.withColumn("_copy", F.explode(F.sequence(F.col("_chunk") * chunk, last)))
    return copies.select(*keys, (F.col("_first") + F.col("_copy")).cast("bigint").alias("row_number"))


def _round(value: Column, keys: Column) -> Column:
    """Keyed quadratic hash of ``value`` below the prime; products stay < 2**62."""
    p = F.lit(PRIME).cast("bigint")
    y = (value + keys["add"]) % p
    return (((y * y) % p) * keys["mul"] + keys["shift"]) % p


def permute(value: Column, n: Column, a: Column, b: Column, seed: int) -> Column:
    """Position of ``value`` in a keyed permutation of 0..n-1."""
    rounds = F.array(
        *[
            F.struct(
                F.lit(i % 2).cast("bigint").alias("odd"),
                F.lit(x).cast("bigint").alias("add"),
                F.lit(y).cast("bigint").alias("mul"),
                F.lit(z).cast("bigint").alias("shift"),
            )
            for i, (x, y, z) in enumerate(round_keys(seed))
        ]
    )

    def step(state: Column, k: Column) -> Column:
        left = (state["l"] + _round(state["r"], k)) % a
        right = (state["r"] + _round(state["l"], k)) % b
        return F.struct(
            F.when(k["odd"] == 0, left).otherwise(state["l"]).alias("l"),
            F.when(k["odd"] == 0, state["r"]).otherwise(right).alias("r"),
        )

    def once(x: Column) -> Column:
        start = F.struct((x % a).cast("bigint").alias("l"), F.call_function("div", x, a).cast("bigint").alias("r"))
        return F.aggregate(rounds, start, step, lambda s: s["r"] * a + s["l"])

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_WALK)), once(value), lambda x, _: F.when(x >= n, once(x)).otherwise(x)
    )
    return F.when(walked >= n, F.raise_error(F.lit("cycle walk did not end")).cast("bigint")).otherwise(walked)


def feistel_shards(df: DataFrame, keys: Sequence[str], n_shards: int, seed: int = 7) -> DataFrame:
    """``keys`` + row_number, position, shard and slot, one row per input row."""
    keys = list(keys)
    clash = {k.lower() for k in keys} & set(NEW_COLUMNS)
    if clash or n_shards < 1:
        raise ValueError(f"keys may not be named {sorted(clash)} and n_shards must be positive")
    numbered = number_rows(df, keys)
    n = df.select(F.count(F.lit(1)).alias("_n"))
    # one row: the size of the table and the two radices
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_n").cast("double")))).cast("bigint")
    size = n.withColumn("_a", a).withColumn("_b", F.greatest(F.lit(1), F.expr("(_n + _a - 1) div _a")))
    joined = numbered.withColumn("_one", F.lit(1)).join(F.broadcast(size.withColumn("_one", F.lit(1))), "_one")
    placed = joined.withColumn("position", permute(F.col("row_number"), F.col("_n"), F.col("_a"), F.col("_b"), seed))
    return placed.select(
        *keys,
        "row_number",
        "position",
        (F.col("position") % n_shards).cast("int").alias("shard"),
        F.expr(f"position div {int(n_shards)}").cast("bigint").alias("slot"),
    )
