"""Per-row tree attributions for a Spark ML forest (ML-15..21, AGG-22/23, JN-7).

Path-dependent Tree SHAP (Lundberg, Erion & Lee, "Consistent Individualized
Feature Attribution for Tree Ensembles", 2018) for the class-1 probability.
The forest's nodes are read from its saved Parquet form (bounded by
trees × 2^(depth+1) nodes), packed into arrays and broadcast; rows are the
parallel axis: ``mapInPandas`` explains each Arrow batch inside the task that
holds it, one leaf at a time for all rows of the batch. Output is a long table (row, feature, value), so the summaries are
ordinary aggregates.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class PackedTree:
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray  # class-1 share at the node
    cover: np.ndarray  # weighted sample count at the node


def pack_forest(spark: SparkSession, model: PipelineModel) -> list[PackedTree]:
    """Save the model to the shared checkpoint folder and read its node table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/forest-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    # Only the forest stage of the pipeline has a node table.
    nodes = spark.read.parquet(f"{path}/stages/*/data").select(
        "treeID",
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.impurityStats").alias("stats"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr"),
    )
    pdf = nodes.toPandas()  # forest size, not data size
    trees = []
    for _, t in pdf.sort_values(["treeID", "id"]).groupby("treeID"):
        n = int(t["id"].max()) + 1
        left = np.full(n, -1, dtype=np.int64)
        right = np.full(n, -1, dtype=np.int64)
        feat = np.full(n, -1, dtype=np.int64)
        thr = np.zeros(n)
        val = np.zeros(n)
        cov = np.zeros(n)
        for r in t.itertuples(index=False):
            i = int(r.id)
            stats = np.asarray(r.stats, dtype=float)
            total = float(stats.sum())
            cov[i] = total
            val[i] = float(stats[1]) / total if total > 0 and len(stats) > 1 else 0.0
            left[i], right[i] = int(r.left), int(r.right)
            if left[i] >= 0:
                feat[i] = int(r.feature)
                thr[i] = float(r.thr[0])
        trees.append(PackedTree(left, right, feat, thr, val, cov))
    return trees


@dataclass(frozen=True)
class Leaf:
    """One root-to-leaf path, its splits merged per feature: a row follows the
    path on feature ``features[i]`` iff its value is in (``low``, ``high``];
    without the feature a ``zero`` share of the cover follows it."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    zero: np.ndarray
    value: float


def leaves(tree: PackedTree) -> list[Leaf]:
    """All paths of a tree (Spark's split rule: value ≤ threshold goes left)."""
    out: list[Leaf] = []
    todo = [(0, {})]
    while todo:
        node, path = todo.pop()
        if tree.left[node] < 0:
            f = sorted(path)
            low, high, zero = (np.array([path[k][i] for k in f], dtype=float) for i in range(3))
            out.append(Leaf(np.array(f, dtype=int), low, high, zero, float(tree.value[node])))
            continue
        f, t = int(tree.feature[node]), float(tree.threshold[node])
        low, high, zero = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((tree.left[node], (low, min(high, t))), (tree.right[node], (max(low, t), high))):
            share = tree.cover[child] / tree.cover[node]
            todo.append((int(child), {**path, f: (*bounds, zero * share)}))
    return out


def tree_shap(x: np.ndarray, paths: Sequence[Leaf], phi: np.ndarray) -> None:
    """Add one tree's attributions for the rows of ``x`` to ``phi`` in place.

    In a path of m features, feature j earns (o_j - z_j) times the Shapley-
    weighted sum over subsets S of the others of prod_S o * prod_rest z, with
    o the 0/1 "row follows" and z the cover share. As the weight of S is the
    integral over [0, 1] of t^|S| (1-t)^(m-1-|S|), that sum is the integral of
    prod_{k≠j} (o_k t + z_k (1-t)): a polynomial of degree m - 1, which
    Gauss-Legendre quadrature with ceil(m/2) points integrates exactly.
    """
    for leaf in paths:
        m = len(leaf.features)
        if m == 0 or leaf.value == 0.0:
            continue
        v = x[:, leaf.features]
        above = np.isneginf(leaf.low) | ~(v <= leaf.low)
        one = (above & (np.isposinf(leaf.high) | (v <= leaf.high))).astype(float)
        weight = np.zeros_like(one)
        points, shares = np.polynomial.legendre.leggauss((m + 1) // 2)
        for t, share in zip((points + 1) / 2, shares / 2):
            terms = one * t + leaf.zero * (1 - t)
            # Products of all the other terms: what is before times what is after.
            before = np.ones_like(terms)
            after = np.ones_like(terms)
            before[:, 1:] = np.cumprod(terms[:, :-1], axis=1)
            after[:, :-1] = np.cumprod(terms[:, :0:-1], axis=1)[:, ::-1]
            weight += share * before * after
        phi[:, leaf.features] += leaf.value * weight * (one - leaf.zero)


def probability_of(trees: Sequence[PackedTree], features: Sequence[str]) -> Column:
    """The forest's class-1 probability as one Column: nested comparisons per
    tree, averaged (a value that is not <= the threshold goes right)."""

    def share(tree: PackedTree, node: int) -> Column:
        if tree.left[node] < 0:
            return F.lit(float(tree.value[node]))
        goes_left = F.col(features[int(tree.feature[node])]) <= F.lit(float(tree.threshold[node]))
        return F.when(goes_left, share(tree, int(tree.left[node]))).otherwise(share(tree, int(tree.right[node])))

    first, *rest = [share(t, 0) for t in trees]
    for other in rest:
        first = first + other
    return first / F.lit(float(len(trees)))


def expected_value(trees: Sequence[PackedTree]) -> float:
    """ML-17: mean over trees of the root's class-1 share."""
    return float(np.mean([t.value[0] for t in trees]))


def explain_rows(x: np.ndarray, forest: Sequence[Sequence[Leaf]]) -> np.ndarray:
    """rows × features attributions of the forest's class-1 probability."""
    phi = np.zeros(x.shape)
    for paths in forest:
        tree_shap(x, paths, phi)
    return phi / len(forest)


def attribution_long(
    spark: SparkSession,
    model: PipelineModel | Sequence[PackedTree],
    rows: DataFrame,
    features: Sequence[str],
    key: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """ML-15/16/18: (key, keep…, feature, feature_value, shap_value) per row and feature.

    ``model`` is a fitted forest or its packed trees. What is broadcast has at
    most trees × 2^depth leaves of depth features, whatever the row count."""
    trees = pack_forest(spark, model) if isinstance(model, PipelineModel) else model
    b_forest = spark.sparkContext.broadcast([leaves(t) for t in trees])
    feats = list(features)
    keep = list(keep)
    schema = ", ".join(
        [f"{key} long"] + [f"{k} string" for k in keep] + ["feature string", "feature_value double", "shap_value double"]
    )

    def run(batches):
        forest = b_forest.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[feats].to_numpy(dtype=float)
            phi = explain_rows(x, forest)
            n, m = phi.shape
            out = {key: np.repeat(pdf[key].to_numpy(), m)}
            for k in keep:
                out[k] = np.repeat(pdf[k].astype(str).to_numpy(), m)
            out["feature"] = np.tile(np.array(feats, dtype=object), n)
            out["feature_value"] = x.reshape(-1)
            out["shap_value"] = phi.reshape(-1)
            yield pd.DataFrame(out)

    src = rows.select(F.col(key).cast("long").alias(key), *[F.col(k).cast("string") for k in keep], *[F.col(f).cast("double") for f in feats])
    return src.mapInPandas(run, schema)


def mean_abs_by_feature(long: DataFrame) -> DataFrame:
    """AGG-22: mean |attribution| per feature, descending."""
    return long.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap")).orderBy(
        F.desc("mean_abs_shap"), "feature"
    )


def mean_abs_by_group(long: DataFrame, group_cols: Sequence[str], key: str) -> DataFrame:
    """AGG-23: mean |attribution| per group × feature with the group's row count,
    largest first. ``long`` has one row per ``key`` and feature, so rows are
    counted without a shuffle on the key."""
    return (
        long.groupBy(*group_cols, "feature")
        .agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"), F.count(key).alias("samples"))
        .orderBy(*group_cols, F.desc("mean_abs_shap"), "feature")
    )


def local_explanations(long: DataFrame, examples: DataFrame, key: str, base_value: float, top: int = 15) -> DataFrame:
    """ML-19: for each chosen example row, its top attributions by |value|."""
    j = long.join(examples, key)
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("shap_value")), "feature")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn(
        "base_value", F.lit(base_value)
    )


def dependence_data(long: DataFrame, top_features: int = 2, always: Sequence[str] = ()) -> DataFrame:
    """ML-20: (feature, x, attribution) for the features with the largest
    mean |attribution| (a top-k over the per-feature aggregate) and those
    named in ``always`` (the study's "best feature and the port")."""
    top = mean_abs_by_feature(long).limit(top_features).select("feature")
    if always:
        named = long.sparkSession.createDataFrame([(f,) for f in always], "feature string")
        top = top.union(named).distinct()
    return long.join(F.broadcast(top), "feature").select("feature", F.col("feature_value").alias("x"), "shap_value")
