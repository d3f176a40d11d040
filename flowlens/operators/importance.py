"""Permutation importance, single and grouped (ML-13, ML-14, AGG-24).

All features × repeats are one long table scored by a single ``transform``
and reduced by one aggregate; nothing loops over jobs per feature. Rows are
numbered and stored once; what moves per draw is (position, values).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.metrics import binary_metrics
from flowlens.operators.model import score
from flowlens.operators.permutation import shuffled_rows


def _f1(scored: DataFrame, group_by: Sequence[str]) -> DataFrame:
    return binary_metrics(scored, group_by, extended=False).select(*group_by, "f1_score")


def _with_baseline(df: DataFrame, baseline: DataFrame) -> DataFrame:
    b = F.broadcast(baseline.select(F.col("f1_score").alias("baseline_f1")).withColumn("_k", F.lit(1)))
    return df.withColumn("_k", F.lit(1)).join(b, "_k").drop("_k")


def permutation_importance(
    model: PipelineModel,
    sample: DataFrame,
    features: Sequence[str],
    key: str,
    label: str = "Label",
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """F1 drop per feature: mean and population std over the repeats."""
    baseline = _f1(score(model, sample, label), [])
    draws = [{"feature": f, "repeat": r} for f in features for r in range(repeats)]
    rows = shuffled_rows(sample.select(key, label, *features), draws, [[d["feature"]] for d in draws], key, seed)
    wide = rows.select(
        "feature", "repeat", label,
        *[F.when(F.col("feature") == f, F.col("_m0")).otherwise(F.col(f).cast("double")).alias(f) for f in features],
    )
    per_rep = _f1(score(model, wide, label), ["feature", "repeat"])
    drops = _with_baseline(per_rep, baseline).withColumn("drop", F.col("baseline_f1") - F.col("f1_score"))
    return (
        drops.groupBy("feature")
        .agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
        .orderBy(F.desc("importance_mean"), "feature")
    )


def group_permutation_importance(
    model: PipelineModel,
    sample: DataFrame,
    groups: Mapping[str, Sequence[str]],
    features: Sequence[str],
    key: str,
    label: str = "Label",
    seed: int = 42,
) -> DataFrame:
    """Baseline F1, F1 with a whole group permuted together, and the drop."""
    baseline = _f1(score(model, sample, label), [])
    members = {g: [c for c in cols if c in features] for g, cols in groups.items()}
    members = {g: m for g, m in members.items() if m}
    rows = shuffled_rows(sample.select(key, label, *features), [{"group": g} for g in members], list(members.values()), key, seed)

    def value(f: str):
        """A feature's own value, or what its group moved here."""
        out = F.col(f).cast("double")
        for g, m in members.items():
            if f in m:
                out = F.when(F.col("group") == g, F.col(f"_m{m.index(f)}")).otherwise(out)
        return out.alias(f)

    wide = rows.select("group", label, *[value(f) for f in features])
    per_group = _f1(score(model, wide, label), ["group"]).withColumnRenamed("f1_score", "permuted_f1")
    about = F.create_map(
        *[x for g, m in members.items() for x in (F.lit(g), F.struct(F.lit(len(m)).alias("n_features"), F.lit(", ".join(m)).alias("features")))]
    )
    out = _with_baseline(per_group.select("*", about[F.col("group")].alias("_about")).select("*", "_about.*"), baseline)
    return out.select(
        "group", "n_features", "baseline_f1", "permuted_f1",
        (F.col("baseline_f1") - F.col("permuted_f1")).alias("f1_drop"), "features",
    ).orderBy(F.desc("f1_drop"), "group")
