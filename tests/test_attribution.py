"""Tree SHAP: local accuracy against Spark's probability, and equality with
brute-force Shapley values on a small tree."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from flowlens.operators import attribution as AT
from flowlens.operators import model as ML


def _brute_shapley(x, tree, m):
    """Exact Shapley values of the path-dependent conditional expectation."""

    def cond_exp(node, subset):
        if tree.left[node] < 0:
            return tree.value[node]
        f = tree.feature[node]
        if f in subset:
            nxt = tree.left[node] if x[f] <= tree.threshold[node] else tree.right[node]
            return cond_exp(nxt, subset)
        lc, rc = tree.left[node], tree.right[node]
        return (tree.cover[lc] * cond_exp(lc, subset) + tree.cover[rc] * cond_exp(rc, subset)) / tree.cover[node]

    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(len(others) + 1):
            for s in itertools.combinations(others, k):
                wgt = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                phi[i] += wgt * (cond_exp(0, set(s) | {i}) - cond_exp(0, set(s)))
    return phi


def test_tree_shap(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.normal(size=(n, 4))
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2]) > 0).astype(int)
    rows = [(i, *map(float, x[i]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, Label int")
    feats = ("a", "b", "c", "d")
    model = ML.fit_forest(df, ML.ForestConfig(feats, num_trees=3, max_depth=4, balanced=False))
    trees = AT.pack_forest(spark, model)
    base = AT.expected_value(trees)
    sample = df.orderBy("row_id").limit(25)
    long = AT.attribution_long(spark, model, sample, feats, "row_id")
    sums = {r["row_id"]: r["s"] for r in long.groupBy("row_id").agg(F.sum("shap_value").alias("s")).collect()}
    probs = {r["row_id"]: r["attack_probability"] for r in ML.score(model, sample).collect()}
    for rid, p in probs.items():
        assert abs(base + sums[rid] - p) < 1e-9
    xs = np.array([r[1:5] for r in rows[:10]])
    phi = np.zeros((10, 4))
    AT.tree_shap(xs, AT.leaves(trees[0]), phi)
    for i in range(10):
        assert np.allclose(phi[i], _brute_shapley(xs[i], trees[0], 4), atol=1e-12)


def test_tree_shap_repeated_features_and_odd_values():
    """A feature split twice on a path, infinite and missing values, a deep chain."""
    nan, inf = float("nan"), float("inf")
    n, depth = 19, 9
    left, right = np.full(n, -1), np.full(n, -1)
    feature, threshold = np.full(n, -1), np.zeros(n)
    value, cover = np.zeros(n), np.zeros(n)
    cover[0], node = 1000.0, 0
    for d in range(depth):  # a chain: node 2d splits, its left child is a leaf
        left[node], right[node] = 2 * d + 1, 2 * d + 2
        feature[node], threshold[node] = d % 6, 0.3 * d - 1
        cover[2 * d + 1], cover[2 * d + 2] = cover[node] * 0.3, cover[node] * 0.7
        value[2 * d + 1] = ((7 * d) % 5) / 5
        node = 2 * d + 2
    value[node] = 0.9
    tree = AT.PackedTree(left, right, feature, threshold, value, cover)
    xs = np.random.default_rng(3).normal(size=(12, 6))
    xs[0] = inf
    xs[1] = -inf
    xs[2] = nan
    phi = AT.explain_rows(xs, [AT.leaves(tree)])
    for i in range(12):
        assert np.allclose(phi[i], _brute_shapley(xs[i], tree, 6), atol=1e-12)


def test_permutation_importance_equals_its_definition(spark):
    """The carried-partner plan gives the F1 drops of the published permutations."""
    from flowlens.operators import importance as IM
    from flowlens.operators import permutation as PM

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    rows = [(i, *map(float, x[i]), int(x[i, 0] + 0.4 * x[i, 1] > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, Label int").repartition(5)
    feats = ("a", "b", "c")
    model = ML.fit_forest(df, ML.ForestConfig(feats, num_trees=3, max_depth=4, balanced=False))

    def f1(frame):
        r = ML.score(model, frame).selectExpr(
            "sum(int(y_true = 1 and y_pred = 1)) tp", "sum(int(y_true != y_pred)) wrong"
        ).first()
        return 2 * r["tp"] / (2 * r["tp"] + r["wrong"])

    got = {r["feature"]: r["importance_mean"] for r in IM.permutation_importance(model, df, feats, "row_id", repeats=2).collect()}
    long = PM.permuted_long(df, feats, "row_id", 2)
    for f in feats:
        drops = []
        for r in range(2):
            moved = long.where((F.col("feature") == f) & (F.col("repeat") == r)).select("row_id", "permuted_value")
            drops.append(f1(df) - f1(df.join(moved, "row_id").withColumn(f, F.col("permuted_value"))))
        assert abs(got[f] - np.mean(drops)) < 1e-12
    groups = {"ab": ("a", "b"), "c": ("c", "absent"), "none": ("absent",)}
    g = {r["group"]: r for r in IM.group_permutation_importance(model, df, groups, feats, "row_id").collect()}
    assert set(g) == {"ab", "c"} and g["c"]["features"] == "c" and g["ab"]["n_features"] == 2
    moved = PM.group_permuted_long(df, {"ab": ("a", "b")}, "row_id").groupBy("row_id").pivot("feature", ["a", "b"]).agg(F.first("permuted_value"))
    want = f1(df.drop("a", "b").join(moved, "row_id"))
    assert abs(g["ab"]["permuted_f1"] - want) < 1e-12
