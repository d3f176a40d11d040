"""Exact per-group ranking that survives skewed groups.

A plain ``row_number() OVER (PARTITION BY stratum ORDER BY key)`` sorts each
stratum inside one task; when one stratum holds a third of the data, that task
holds a third of the data. The operators here never do that:

* ``mark_top_k`` — keep the first ``quota`` rows of each group in a seeded
  hash order. One aggregate (map-side partial counts) makes a fixed-width
  histogram of the order keys of every group; it gives the group's size and
  the hash bucket that holds the quota boundary. Only that bucket, one part in
  2^``bucket_bits`` of the group, is ranked; the result is one cutoff per
  group. The final pass compares each row with its group's cutoff.
* ``dense_rank_in_group`` — 0-based position of each row inside its group by
  a unique key (row numbers within a file, global row ids). Rows are
  range-partitioned by (group, key) from sampled boundaries, sorted and stored
  with their place; (group, partition) counts give each run's offset.

Tables with one row per group are read to the driver up to
``MAX_GROUPS_BROADCAST`` rows and then broadcast, so the data rows stay where
they are and no group is gathered by its key; a table with more groups is
joined by an ordinary shuffle join instead. The result is the same.

Results equal the plain window exactly (given a unique order key).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import stored

ORDER_BITS = 60
DEFAULT_BUCKET_BITS = 14
MAX_GROUPS_BROADCAST = 100_000


def seeded_order(seed: int | str, *cols: str | Column) -> Column:
    """md5 hex of ``seed|key…``: the same text in Spark and DuckDB.

    Ordering by it is a seeded shuffle that does not depend on partitioning.
    """
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def order_prefix(md5_hex: Column) -> Column:
    """First 60 bits of an md5 hex string as a non-negative LONG."""
    return F.conv(F.substring(md5_hex, 1, ORDER_BITS // 4), 16, 10).cast("bigint")


def _window(group_cols: Sequence[str]):
    return Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))


def _small(table: DataFrame) -> tuple[DataFrame, bool]:
    """Compute a one-row-per-group table once; True when it was small enough
    to be sent to every executor, else the lazy table itself."""
    rows = table.limit(MAX_GROUPS_BROADCAST + 1).collect()
    if len(rows) > MAX_GROUPS_BROADCAST:
        return table, False
    return table.sparkSession.createDataFrame(rows, table.schema), True


def _null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False
) -> DataFrame:
    """Join on ``keys`` with NULL = NULL; keeps the left key columns only.

    ``small`` marks a right side whose size was checked: it is broadcast.
    Without keys the right side is a one-row global table: it is joined on a
    constant key and broadcast (its size is one row by construction).
    """
    if not keys:
        left = left.withColumn("__one", F.lit(1))
        right = F.broadcast(right.withColumn("__one", F.lit(1)))
        return left.join(right, "__one", how).drop("__one")
    renamed = right
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"__rk{i}")
    cond = [left[k].eqNullSafe(renamed[f"__rk{i}"]) for i, k in enumerate(keys)]
    out = left.join(F.broadcast(renamed) if small else renamed, cond, how)
    return out.drop(*[f"__rk{i}" for i in range(len(keys))])


def mark_top_k(
    df: DataFrame,
    group_cols: Sequence[str],
    quota: int | Callable[[DataFrame], DataFrame],
    order_md5: str,
    flag: str = "selected",
    bucket_bits: int = DEFAULT_BUCKET_BITS,
) -> DataFrame:
    """Add boolean ``flag``: row is among the first ``quota`` of its group.

    ``order_md5`` names a column of md5 hex strings (see ``seeded_order``),
    unique per row. ``quota`` is an int cap or a function adding ``_quota``
    to the per-group count table (columns ``group_cols`` + ``_n``).

    Reads ``df`` three times: histogram, boundary buckets, final pass; the
    first two run when the function is called and read only the group and
    order columns.
    """
    g = list(group_cols)
    keyed = df.select(
        *g,
        F.col(order_md5).alias("_md5"),
        F.shiftrightunsigned(order_prefix(F.col(order_md5)), ORDER_BITS - bucket_bits).alias("_bucket"),
    )
    hist = keyed.groupBy(*g, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    if isinstance(quota, int):
        hist = hist.withColumn("_quota", F.least(F.sum("_c").over(_window(g)), F.lit(int(quota))).cast("bigint"))
    else:
        counts, few = _small(quota(hist.groupBy(*g).agg(F.sum("_c").alias("_n"))))
        hist = _null_safe_join(hist, counts.select(*g, "_quota"), g, small=few)
    # A window holds at most 2^bucket_bits rows of one group.
    w = _window(g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.where(F.col("_quota") > 0).withColumn("_cum", F.sum("_c").over(w))
    before = F.col("_cum") - F.col("_c")
    boundary, few = _small(
        hist.where((before < F.col("_quota")) & (F.col("_cum") >= F.col("_quota"))).select(
            *g, F.col("_bucket").alias("_bb"), (F.col("_quota") - before).alias("_need")
        )
    )
    # Rank only the rows of the boundary bucket; keep the need-th md5 as cutoff.
    edge = _null_safe_join(keyed, boundary, g, small=few).where(F.col("_bucket") == F.col("_bb"))
    cut, few = _small(
        edge.withColumn("_rn", F.row_number().over(_window(g).orderBy("_md5")))
        .where(F.col("_rn") == F.col("_need"))
        .select(*g, F.col("_md5").alias("_cut"))
    )
    out = _null_safe_join(df, cut, g, "left", small=few)
    # No cutoff means a quota of zero.
    return out.withColumn(flag, F.col("_cut").isNotNull() & (F.col(order_md5) <= F.col("_cut"))).drop("_cut")


def top_k_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    k: int,
    order_md5: str,
    bucket_bits: int = DEFAULT_BUCKET_BITS,
) -> DataFrame:
    """Rows among the first ``k`` of their group in md5 order (exact cap)."""
    marked = mark_top_k(df, group_cols, k, order_md5, "_keep", bucket_bits)
    return marked.where(F.col("_keep")).drop("_keep")


def dense_rank_in_group(
    df: DataFrame,
    group_cols: Sequence[str],
    key: str,
    out: str = "rank",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """0-based position of each row in its group by a unique ``key``.

    Rows are range-partitioned by (group, key) — Spark samples the boundaries,
    so neither a hot group nor an outlying key fills one task — sorted, numbered
    inside their partition and stored once. The (group, partition) counts give
    the offsets. ``rows_per_bucket`` sets the partition size instead of Spark's
    own choice (it counts the rows first)."""
    g = list(group_cols)
    spread = [max(1, -(-df.count() // rows_per_bucket))] if rows_per_bucket else []
    ordered = df.repartitionByRange(*spread, *g, key).sortWithinPartitions(*g, key)
    rows = stored(ordered.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    # The id counts up inside a partition, whose number is in its upper bits.
    rows = rows.withColumn("_part", F.shiftright("_place", 33))
    runs = rows.groupBy(*g, "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_place").alias("_first"))
    earlier = _window(g).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_c").over(earlier), F.lit(0)) - F.col("_first")
    offsets, few = _small(runs.withColumn("_shift", shift).select(*g, "_part", "_shift"))
    placed = _null_safe_join(rows, offsets, [*g, "_part"], small=few)
    return placed.withColumn(out, (F.col("_place") + F.col("_shift")).cast("bigint")).drop("_place", "_part", "_shift")
