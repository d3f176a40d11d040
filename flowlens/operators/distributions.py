"""Counting operators: class/family/label distributions, shares, top values,
class weights, distinct checks (AGG-1, AGG-2, AGG-14..17, AGG-25, FLT-9/10).

All are single aggregates with partial (map-side) combine; windows only run
over the aggregated rows, whose count is bounded by the number of distinct
keys, never by the number of input rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_distribution(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count")).orderBy(label)


def family_distribution(df: DataFrame, family: str = "attack_family") -> DataFrame:
    return df.groupBy(family).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), family)


def label_distribution(
    df: DataFrame, family: str = "attack_family", label: str = "original_label"
) -> DataFrame:
    return (
        df.groupBy(family, label)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.asc(family), F.desc("count"), F.asc(label))
    )


def distribution_tables(
    df: DataFrame, label: str = "Label", family: str = "attack_family", original: str = "original_label"
) -> DataFrame:
    """All three distribution tables from one scan (GROUPING SETS).

    ``table`` says which table a row belongs to: class, family or label.
    """
    sets = [[label], [family], [family, original]]
    agg = df.groupingSets(sets, label, family, original).agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_gid")
    )
    # grouping_id bits: label=4, family=2, original=1 (1 = aggregated away)
    return agg.select(
        F.when(F.col("_gid") == 3, "class").when(F.col("_gid") == 5, "family").otherwise("label").alias("table"),
        label, family, original, "count",
    )


def value_share(df: DataFrame, key: str) -> DataFrame:
    """Normalised class share: ``count / sum(count)``."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("count") / total)


def top_values_per_class(df: DataFrame, class_col: str, value_col: str, k: int = 20) -> DataFrame:
    """Top-k values inside each class by count (ties: smaller value first),
    with the share of the class each value holds.

    The rank limit runs before the exchange (at most ``k`` values of a class
    leave a task); class totals are an aggregate of their own."""
    counts = df.groupBy(class_col, value_col).agg(F.count(F.lit(1)).alias("count"))
    w_rank = Window.partitionBy(class_col).orderBy(F.desc("count"), F.asc(value_col))
    top = counts.withColumn("rank", F.row_number().over(w_rank)).where(F.col("rank") <= k)
    totals = df.groupBy(F.col(class_col).alias("_class")).agg(F.count(F.lit(1)).alias("_total"))
    return top.join(totals, F.col(class_col).eqNullSafe(F.col("_class"))).select(
        class_col, value_col, "count", (F.col("count") / F.col("_total")).alias("share"), "rank"
    )


def class_weights(df: DataFrame, label: str = "Label") -> DataFrame:
    """Balanced weights ``n / (n_classes · n_c)``, one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(F.lit(0))
    n = F.sum("count").over(w)
    k = F.count(F.lit(1)).over(w)
    return counts.withColumn("weight", n / (k * F.col("count")))


def with_class_weight(df: DataFrame, label: str = "Label", out: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (tiny broadcast table:
    one row per class)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label, "left")


def distinct_count(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_distinct(col).alias(f"distinct_{col}"))


def require_two_classes(df: DataFrame, label: str) -> None:
    """Raise when fewer than two classes are present (FLT-10)."""
    n = df.select(label).distinct().limit(2).count()
    if n < 2:
        raise ValueError(f"Only {n} class found in '{label}'; binary classification needs two.")
