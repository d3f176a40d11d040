"""Extreme examples for local explanations (WIN-12, WIN-13).

Chosen with ``max`` over structs — an aggregate with a partial (map-side)
step — instead of a window, so a huge class never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extreme_examples(
    pred: DataFrame,
    group_by: Sequence[str] = ("dataset",),
    key: str = "row_id",
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    prob: str = "attack_probability",
    prefer_correct: bool = False,
) -> DataFrame:
    """Per group: the attack with the highest probability and the benign row
    with the lowest (first row id on ties). With ``prefer_correct`` correctly
    predicted rows win, falling back to all rows of the class. A group that
    lacks a class takes that example from all its rows."""
    correct = (F.col(y_true) == F.col(y_pred)).cast("int") if prefer_correct else F.lit(0)
    high = F.struct(correct.alias("c"), F.col(prob).alias("p"), (-F.col(key)).alias("k"))
    low = F.struct(correct.alias("c"), (-F.col(prob)).alias("p"), (-F.col(key)).alias("k"))
    t = F.col(y_true)
    # a group without the class takes its example from all its rows
    attack = F.coalesce(F.max(F.when(t == 1, high)), F.max(high))
    benign = F.coalesce(F.max(F.when(t == 0, low)), F.max(low))
    agg = pred.groupBy(*group_by).agg(attack.alias("_a"), benign.alias("_b"))
    rows = F.explode(
        F.array(
            F.struct(F.lit("attack").alias("example"), (-F.col("_a.k")).alias(key), F.col("_a.p").alias(prob)),
            F.struct(F.lit("benign").alias("example"), (-F.col("_b.k")).alias(key), (-F.col("_b.p")).alias(prob)),
        )
    )
    return agg.select(*group_by, rows.alias("e")).select(*group_by, "e.*").where(F.col(key).isNotNull())
