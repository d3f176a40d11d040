"""Guards that are part of a plan (FLT-9, FLT-10, JN-2, PRJ-11).

A guard is a filter that lets every row pass or ends the job with a message.
It runs in the job that computes the result, on a table the plan has anyway:
no extra pass over the rows and no driver round trip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(df: DataFrame, ok: Column, message: Column) -> DataFrame:
    """All rows of ``df``; the job fails with ``message`` at a row that is not ``ok``
    (null counts as not ok)."""
    # not deterministic on purpose: the optimizer may neither evaluate the
    # condition on null rows while planning nor move it below a join
    here = F.monotonically_increasing_id() >= 0
    fail = F.raise_error(message).cast("boolean")
    return df.where(F.when(here & F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(fail))


def required_counts(df: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """FLT-9: (key, count) of the wanted values, in one aggregate; a value
    without rows ends the job, an empty ``df`` with the first of them."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    listed = df.sparkSession.createDataFrame([(w,) for w in wanted], f"`{key}` string")
    found = listed.join(counts, key, "left")
    return guarded(found, F.col("count").isNotNull(), F.concat(F.lit(f"no rows with {key} = "), F.col(key)))


def two_class_weights(df: DataFrame, label: str) -> DataFrame:
    """FLT-10 with AGG-25: balanced weights ``n / (classes * count)`` per class;
    fewer than two classes end the job, also when ``df`` is empty. A null label
    is no class and has no weight."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.agg(F.count(F.lit(1)).alias("_classes"), F.sum("count").alias("_n"))
    told = F.concat(F.lit(f"two classes needed in {label}, found "), F.col("_classes").cast("string"))
    # the totals are one row, kept by the outer join whatever the counts hold
    checked = guarded(totals, F.col("_classes") >= 2, told).withColumn("_one", F.lit(1))
    both = checked.join(counts.withColumn("_one", F.lit(1)), "_one", "left")
    return both.select(label, "count", (F.col("_n") / (F.col("_classes") * F.col("count"))).alias("weight"))
