"""Experiment bookkeeping over metric tables (AGG-19, ML-6, ML-22).

Metric tables are tiny (one row per seed / variant); these are plain
aggregates and unions over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEEDS = (42, 100, 2023, 777, 1337)
SUMMARY_METRICS = (("accuracy", "accuracy"), ("precision", "precision"), ("recall", "recall"), ("f1", "f1_score"))


def seed_summary(per_seed: DataFrame, group_by: Sequence[str] = ("experiment_name",)) -> DataFrame:
    """Mean and sample std of each metric over seeds; std is 0.0 for one seed."""
    aggs = []
    for short, col in SUMMARY_METRICS:
        aggs.append(F.avg(col).alias(f"{short}_mean"))
        aggs.append(F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias(f"{short}_std"))
    return per_seed.groupBy(*group_by).agg(*aggs)


def subset_experiment(
    df: DataFrame,
    predicate,
    drop_cols: Sequence[str],
    features: Sequence[str],
    label: str = "Label",
    key: str = "row_id",
    num_trees: int = 50,
    max_depth: int = 15,
    seed: int = 42,
) -> DataFrame:
    """ML-9: keep a subset (e.g. one port), drop the column it was chosen by,
    split (stratified on the label), refit the scaler on the subset's training
    rows, train an unweighted forest and report metrics with subset sizes."""
    from flowlens.operators import metrics as M
    from flowlens.operators import model as ML
    from flowlens.operators import profile as P
    from flowlens.operators import sampling as S
    from flowlens.operators.distributions import require_two_classes
    from flowlens.session import stored

    sub = df.where(predicate)
    require_two_classes(sub, label)
    feats = [f for f in features if f not in set(drop_cols)]
    split = stored(S.stratified_split(sub, label, key=key), "subset-split")
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    params = P.fit_scaler(train, feats)
    train, test = P.apply_scaler(train, params), P.apply_scaler(test, params)
    cfg = ML.ForestConfig(tuple(feats), label=label, key=key, num_trees=num_trees, max_depth=max_depth, seed=seed, balanced=False)
    model = ML.fit_forest(train, cfg)
    m = M.binary_metrics(ML.score(model, test, label), extended=False)
    sizes = split.agg(
        F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).cast("bigint").alias("train_rows"),
        F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).cast("bigint").alias("test_rows"),
        F.count(F.lit(1)).alias("total_subset_rows"),
    )
    return m.withColumn("_k", F.lit(1)).join(F.broadcast(sizes.withColumn("_k", F.lit(1))), "_k").drop("_k")


def attack_study(
    df: DataFrame,
    attack_class: Column,
    target: str,
    features: Sequence[str],
    key: str = "row_id",
    num_trees: int = 50,
    max_depth: int = 15,
    seed: int = 42,
) -> DataFrame:
    """ML-4 / FLT-8: keep one attack class and the benign rows of a label map,
    refuse a single class, split, train and evaluate; metrics with set sizes."""
    from flowlens.functions.labels import legacy_binary
    from flowlens.operators import metrics as M
    from flowlens.operators import model as ML
    from flowlens.operators import sampling as S
    from flowlens.operators.distributions import require_two_classes
    from flowlens.session import stored

    kept = df.withColumn("attack_class", attack_class).where(F.col("attack_class").isin(target, "Benign"))
    kept = kept.withColumn("Label", legacy_binary(F.col("attack_class")))
    require_two_classes(kept, "Label")
    split = stored(S.stratified_split(kept, "Label", key=key), "study-split")
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    cfg = ML.ForestConfig(tuple(features), key=key, num_trees=num_trees, max_depth=max_depth, seed=seed)
    m = M.binary_metrics(ML.score(ML.fit_forest(train, cfg), test), extended=False)
    return m.select(F.lit(target).alias("study"), F.lit(train.count()).cast("bigint").alias("train_rows"), *m.columns)


def planned_experiments(features: Sequence[str], fragment: str = "port") -> dict[str, tuple[str, ...]]:
    """ML-6, PRJ-18: feature list per experiment. The destination port is looked
    up by a part of its name; without one its experiment is left out."""
    from flowlens.functions.names import find_column

    plan = {"Baseline": tuple(features)}
    port = find_column(list(features), fragment)
    if port is not None:
        plan["No Destination Port"] = tuple(f for f in features if f != port)
    return plan


def feature_experiments(
    train: DataFrame, test: DataFrame, experiments: dict[str, Sequence[str]], seeds: Sequence[int] = SEEDS, **forest
) -> DataFrame:
    """ML-6: one forest per named feature list and seed, summarised per name.
    ``train`` and ``test`` should be stored tables, or ``train`` a ``laid_out`` one
    (with ``laid_out=True``)."""
    from flowlens.operators import metrics as M
    from flowlens.operators import model as ML

    out = None
    for name, features in experiments.items():
        for seed in seeds:
            cfg = ML.ForestConfig(tuple(features), seed=seed, balanced=False, **forest)
            m = M.binary_metrics(ML.score(ML.fit_forest(train, cfg), test), extended=False)
            m = m.select(F.lit(name).alias("experiment_name"), F.lit(len(features)).alias("n_features"), F.lit(seed).alias("seed"), *m.columns)
            out = m if out is None else out.unionByName(m)
    return seed_summary(out, ("experiment_name", "n_features"))
