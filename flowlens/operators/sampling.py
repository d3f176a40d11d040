"""Seeded, exact, layout-independent sampling and splitting (WIN-1..9).

Randomness is an md5 order over ``seed|key`` (identical in every engine and
for every partitioning); selection goes through the skew-safe ranking of
``flowlens.operators.ranking``. Nothing is approximate: ``sampleBy`` and
``randomSplit`` are not used because their sizes are not exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.guards import guarded
from flowlens.operators.ranking import _small, dense_rank_in_group, mark_top_k, seeded_order, top_k_per_group

RANDOM_STATE = 42
TEST_SIZE = 0.2
MAX_SAMPLES_PER_SOURCE_LABEL = 50_000
SOURCE_LABEL_KEYS = ("source_file", "original_label", "attack_family")


def capped_sample(
    df: DataFrame,
    group_cols: Sequence[str] = SOURCE_LABEL_KEYS,
    cap: int = MAX_SAMPLES_PER_SOURCE_LABEL,
    key: str = "row_id",
    seed: int = RANDOM_STATE,
) -> DataFrame:
    """At most ``cap`` rows per group, chosen by seeded hash order (WIN-3,
    WIN-6, WIN-7 with other keys)."""
    ordered = df.withColumn("_order", seeded_order(seed, key))
    return top_k_per_group(ordered, list(group_cols), cap, "_order").drop("_order")


def bounded_sample(df: DataFrame, n: int, key: str = "row_id", seed: int = RANDOM_STATE) -> DataFrame:
    """At most ``n`` rows over the whole table (WIN-8), exact and skew-safe:
    no single task gathers n × partitions candidates."""
    return capped_sample(df, (), n, key, seed)


def _file_place(column: str):
    """(part number, number of the file within the part) of a written file."""
    number = lambda pattern: F.regexp_extract(column, pattern, 1).try_cast("bigint")
    return F.struct(number(r"part-(\d+)[^/]*$"), F.coalesce(number(r"\.c(\d+)\.[^/]*$"), F.lit(0)))


def written_shuffle(
    df: DataFrame, path: str, key: str = "row_id", seed: int = RANDOM_STATE, order: str = "shuffle_order"
) -> DataFrame:
    """WIN-9: the rows written in a seeded global order (column ``order``, kept
    in the files): one range exchange, sorted inside the parts."""
    ordered = df.withColumn(order, seeded_order(seed, key))
    ordered.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(ordered.schema).parquet(path)


def shuffle_positions(written: DataFrame, order: str = "shuffle_order", out: str = "position") -> DataFrame:
    """0-based position of each row of a ``written_shuffle`` in its global order.

    A row's place in its file is file metadata and a file's offset a prefix sum
    over the one-row-per-file counts, so no row moves. A file that does not
    start after the end of the one before it ends the job."""
    rows = written.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.row_index"))
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_low"), F.max(order).alias("_high"))
    w = Window.partitionBy(F.lit(0)).orderBy(_file_place("_file"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_end", F.lag("_high").over(w))
    after = F.col("_end").isNull() | (F.col("_end") < F.col("_low"))
    files = guarded(files, after, F.concat(F.lit("not in shuffle order: "), F.col("_file"))).select("_file", "_off")
    offsets, few = _small(files)
    placed = rows.join(F.broadcast(offsets) if few else offsets, "_file")
    return placed.withColumn(out, (F.col("_off") + F.col("_at")).cast("bigint")).drop("_file", "_off", "_at")


def choose_stratum(df: DataFrame, family: str = "attack_family", label: str = "Label") -> str:
    """WIN-5: stratify on the family when every family has ≥ 2 rows."""
    smallest = df.groupBy(family).count().agg(F.min("count")).first()[0]
    return family if smallest is not None and smallest >= 2 else label


def _test_quota(test_size: float):
    """Per-stratum test quota: the train size n − ceil(test_size·n) is spread by
    floor plus largest remainder (ties: stratum ascending); test gets the rest.

    Runs on the per-stratum count table (one row per stratum).
    """

    def add(counts: DataFrame) -> DataFrame:
        g = [c for c in counts.columns if c != "_n"]
        total = F.sum("_n").over(Window.partitionBy(F.lit(0)))
        n_test = F.ceil(F.lit(float(test_size)) * total).cast("bigint")
        c = counts.withColumn("_total", total).withColumn("_ntrain", F.col("_total") - n_test)
        # Exact integer arithmetic (DECIMAL(38,0): n·n_train overflows LONG at scale).
        big = lambda x: F.col(x).cast("decimal(38,0)")
        prod = big("_n") * big("_ntrain")
        c = c.withColumn("_floor", F.call_function("div", prod, big("_total")).cast("bigint")).withColumn(
            "_rem", prod - big("_floor") * big("_total")
        )
        need = F.col("_ntrain") - F.sum("_floor").over(Window.partitionBy(F.lit(0)))
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc("_rem"), *[F.asc(x) for x in g])
        c = c.withColumn("_extra", F.when(F.row_number().over(order) <= need, 1).otherwise(0))
        train_q = F.col("_floor") + F.col("_extra")
        return c.withColumn("_quota", (F.col("_n") - train_q).cast("bigint")).select(*g, "_n", "_quota")

    return add


def stratified_split(
    df: DataFrame,
    stratum: str,
    test_size: float = TEST_SIZE,
    key: str = "row_id",
    seed: int = RANDOM_STATE,
    out: str = "split",
) -> DataFrame:
    """Exact stratified split (WIN-4): adds ``split`` = 'train' | 'test'."""
    ordered = df.withColumn("_order", seeded_order(seed, key))
    marked = mark_top_k(ordered, [stratum], _test_quota(test_size), "_order", "_is_test")
    return marked.withColumn(out, F.when(F.col("_is_test"), F.lit("test")).otherwise(F.lit("train"))).drop(
        "_order", "_is_test"
    )


def row_number_in_file(df: DataFrame, file_col: str, order_col: str, out: str = "source_row") -> DataFrame:
    """WIN-1: 0-based position of each row inside its file by ``order_col``."""
    return dense_rank_in_group(df, [file_col], order_col, out)


def global_row_ids(
    df: DataFrame, file_col: str = "source_file", row_col: str = "source_row", out: str = "row_id"
) -> DataFrame:
    """WIN-2: 0-based id over all rows in (file, row) order.

    Position inside the file (skew-safe bucketed rank) plus the file's offset,
    a prefix sum over the per-file counts (one row per file).
    """
    ranked = dense_rank_in_group(df, [file_col], row_col, "_pos")
    counts = df.groupBy(file_col).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(F.lit(0)).orderBy(file_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.withColumn("_off", F.sum("_c").over(w) - F.col("_c")).select(file_col, "_off")
    return (
        ranked.join(offsets, file_col, "inner")
        .withColumn(out, (F.col("_off") + F.col("_pos")).cast("bigint"))
        .drop("_off", "_pos")
    )
