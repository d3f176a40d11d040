"""Feature profiling: population scaler, single-feature AUC, train/test
overlap (AGG-20, ML-1, AGG-21, WIN-14, JN-3, SET-5, SCL-12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import stored


def scaler_params(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, population std/variance and the scale (std, or 1 when std = 0)
    per feature — one aggregate over the (training) rows, unpivoted."""
    aggs = []
    for i, c in enumerate(features):
        aggs += [F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}")]
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("variance"))
            for i, c in enumerate(features)
        ]
    )
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    std = F.sqrt("variance")
    return out.select(
        "feature",
        "mean",
        std.alias("std"),
        "variance",
        F.when(std == 0, F.lit(1.0)).otherwise(std).alias("scale"),
    )


def fit_scaler(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Driver-side parameters (two numbers per feature) for ``apply_scaler``."""
    return {r["feature"]: (r["mean"], r["scale"]) for r in scaler_params(df, features).collect()}


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """``(x - mean) / scale`` as literals in one projection; a feature constant
    in training keeps ``x - mean`` (scale 1), not 0."""
    cols = [
        ((F.col(c) - F.lit(params[c][0])) / F.lit(params[c][1])).alias(c) if c in params else F.col(c)
        for c in df.columns
    ]
    return df.select(*cols)


def single_feature_auc(df: DataFrame, features: Sequence[str], label: str = "Label") -> DataFrame:
    """Rank-sum AUC of each feature alone, folded to ``max(auc, 1 - auc)``,
    largest first.

    Ties take half credit (average ranks). Integer form:
    2·AUC·P·N = Σ_v pos_v · (2 · neg_below_v + neg_v). The distinct values are
    range-partitioned by (feature, value) from sampled quantiles and stored
    once; running negatives are taken inside (feature, range) and shifted by
    the totals of earlier ranges, so a heavy-tailed feature has no hot range.
    NULL when a class is absent.
    """
    long = df.select(
        F.col(label).cast("int").alias("_y"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
        ).alias("_f"),
    ).select("_f.feature", "_f.value", "_y").where(F.col("value").isNotNull())
    per_value = long.groupBy("feature", "value").agg(
        F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col("_y") == 0, 1).otherwise(0)).cast("bigint").alias("neg"),
    )
    ranges = per_value.repartitionByRange("feature", "value").withColumn("_b", F.spark_partition_id())
    ranges = stored(ranges, "auc-values")
    hist = ranges.groupBy("feature", "_b").agg(F.sum("neg").alias("_nb"), F.sum("pos").alias("_pb"))
    wb = Window.partitionBy("feature").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = hist.withColumn("_off", F.coalesce(F.sum("_nb").over(wb), F.lit(0))).select("feature", "_b", "_off")
    wv = Window.partitionBy("feature", "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranges.withColumn("_below_in", F.coalesce(F.sum("neg").over(wv), F.lit(0))).join(offs, ["feature", "_b"])
    res = ranked.groupBy("feature").agg(
        # DECIMAL(38,0): pos · neg-counts overflows LONG on very large tables.
        F.sum(
            F.col("pos").cast("decimal(38,0)")
            * (F.lit(2) * (F.col("_off") + F.col("_below_in")) + F.col("neg")).cast("decimal(38,0)")
        ).alias("S"),
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
    )
    auc = F.col("S").cast("double") / (F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double"))
    folded = F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(None).cast("double")).otherwise(
        F.greatest(auc, F.lit(1.0) - auc)
    )
    return res.select("feature", folded.alias("single_feature_auc")).orderBy(F.desc("single_feature_auc"), "feature")


def train_test_overlap(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "Label"
) -> DataFrame:
    """Distinct rows present in both sets, on full rows and on features only.

    Each side is read once: rows are grouped by (features, label) with their
    counts on either side, then rolled up to the features. Exact, no hashing;
    NULLs are equal as in INTERSECT."""
    full = [*features, label]
    sides = train.select(*full, F.lit(1).alias("_tr"), F.lit(0).alias("_te")).union(
        test.select(*full, F.lit(0).alias("_tr"), F.lit(1).alias("_te"))
    )
    in_both = F.when((F.sum("_tr") > 0) & (F.sum("_te") > 0), 1).otherwise(0)
    rows = sides.groupBy(*full).agg(F.sum("_tr").alias("_tr"), F.sum("_te").alias("_te"), in_both.alias("_full"))
    feats = rows.groupBy(*features).agg(
        F.sum("_tr").alias("_tr"), F.sum("_te").alias("_te"), F.sum("_full").alias("_full"), in_both.alias("_feat")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return feats.agg(
        total("_tr").alias("train_rows"),
        total("_te").alias("test_rows"),
        total("_full").alias("full_row_overlap"),
        total("_feat").alias("feature_overlap"),
    )


def overlapping_rows(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Test rows whose columns also occur in train (left semi join)."""
    return test.join(train.select(*cols).distinct(), list(cols), "left_semi")


def row_hash(cols: Sequence[str]):
    """SCL-12: 64-bit row hash over the given columns."""
    return F.xxhash64(*cols)
