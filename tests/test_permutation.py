"""Permutations by arithmetic: one position each, whatever n; one range sort
whatever the number of draws; experiments planned from a schema."""

import math
from collections import Counter
from dataclasses import replace
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.operators import model as ML
from flowlens.operators import permutation as PM
from flowlens.operators.experiments import planned_experiments
from flowlens.operators.ranking import order_prefix, seeded_order
from flowlens.session import ensure_checkpoint_dir


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_every_draw_is_a_permutation(spark, n):
    rows = spark.range(n).select(F.col("id").alias("_pos"), F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("b"))
    draws = [{"feature": f, "repeat": r} for f in ("a", "b") for r in range(2)]
    moved = PM.moved_values(rows, n, draws, [[d["feature"]] for d in draws]).collect()
    by_draw = {d: {r["_to"]: r["_m0"] for r in moved if r["_draw"] == d} for d in range(len(draws))}
    for d, places in by_draw.items():
        assert sorted(places) == list(range(n))
        assert sorted(places.values()) == [float(i * (1 + d // 2)) for i in range(n)]
    if n == 1000:
        assert by_draw[0] != by_draw[1]
        assert sum(p == v for p, v in by_draw[0].items()) < 20  # hardly a fixed point


def test_draws_share_one_numbering(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"), F.lit(1.0).alias("b"))
    long = PM.permuted_long(df, ["a", "b"], "k", repeats=5)
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan  # rows were numbered and stored before
    assert long.count() == 200 * 10
    assert PM.permuted_long(df.limit(0), ["a"], "k").count() == 0


def test_port_experiment_needs_a_port():
    assert list(planned_experiments(("Flow Duration", "Destination Port"))) == ["Baseline", "No Destination Port"]
    assert planned_experiments(("a", "b")) == {"Baseline": ("a", "b")}


def test_values_travel_packed(spark):
    """A block's values come as arrays and meet its rows once: no join on
    (position, draw), and the same values as position by position."""
    df = spark.range(3000).select(
        F.concat(F.lit("r"), F.col("id")).alias("k"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("a.b"),
        (F.col("id") * 3).cast("int").alias("c"),
    ).where(F.col("k") != "r17")
    draws = [{"feature": f, "repeat": r} for f in ("a.b", "c") for r in range(2)]
    moves = [["a.b"], ["a.b", "c"], ["c"], ["c", "a.b"]]
    found = PM.shuffled_rows(df, draws, moves, "k")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "_to" not in plan
    rows, n = PM.numbered_rows(df, "k", 42)
    plain = rows.join(PM.moved_values(rows, n, draws, moves), F.col("_pos") == F.col("_to"))
    cols = ["k", "`a.b`", "c", "_draw", "_m0", "_m1"]
    assert sorted(map(str, found.select(*cols).collect())) == sorted(map(str, plain.select(*cols).collect()))


def test_words_are_exact():
    """Numbers travel bit for bit, whatever they are; short decimals in a few bytes."""
    rng = np.random.default_rng(1)
    odd = [0.0, -0.0, 1.5, -2.25, math.nan, math.inf, -math.inf, 2.0**31, 5e-324, 1 / 3, None]
    null_like = np.array([0x7FF0000000000001, 0x7FF0000000000002], np.uint64).view(np.float64)
    cents = rng.integers(-9_000_000, 9_000_000, 1000) / 100
    for column in (odd, [None, None], [], [-0.0, 1.0], [0.5, None, -7.25], [*null_like, None, 3.0], list(cents), list(cents * 3), list(rng.normal(size=300))):
        x = pa.array(column, pa.float64())
        scale, null, words = PM.number_words(x)
        words = PM.unsqueezed(PM.squeezed([words[:3], words[3:]]))
        found, missing = PM.word_numbers(words, np.full(len(x), scale), np.full(len(x), null, np.uint64))
        assert missing.tolist() == [v is None for v in column]
        assert found[~missing].tobytes() == x.drop_null().to_numpy().tobytes()
    assert PM.number_words(pa.array(cents))[0] == 100
    assert len(PM.squeezed([PM.number_words(pa.array(cents))[2]])) < 4 * len(cents)


def test_rows_and_moved_values_travel_once(spark):
    """Two exchanges, one read twice, and no table written: before, rows were
    moved to be numbered, written, and moved again to meet the values."""
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 900 / 100).alias("a"), F.col("id").cast("int").alias("b"))
    root = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(root.iterdir())
    moved = PM.moved_rows(df, [{"d": 0}, {"d": 1}], [["a"], ["b", "a"]], "k")
    rows = moved.collect()
    plan = moved._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") == 2 and plan.count("ReusedExchange") == 1
    assert set(root.iterdir()) == before
    for own, found in (("a", "_m0_0"), ("b", "_m1_0"), ("a", "_m1_1")):
        assert sorted(float(r[own]) for r in rows) == sorted(r[found] for r in rows)


def test_crowded_keys_are_cut(spark):
    """Rows of one key that are too many for a block are spread over several,
    and every value still moves to one row."""
    n, hot = 9000, 6000
    df = spark.range(n).select(F.when(F.col("id") >= hot, F.col("id")).alias("k"), (F.col("id") * 0.5).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("b"))
    order = order_prefix(seeded_order(42, "k"))
    blocks = PM.Blocks(df.select(order.alias("_order"), F.pmod(F.xxhash64("a"), F.lit(PM.TIES)).alias("_tie")), 4)
    sizes = np.diff(blocks.firsts)
    assert blocks.firsts[-1] == n and sizes.max() < 1.25 * PM.SMALLEST_BLOCK and (sizes > 0).sum() >= 6
    rows = PM.group_permuted_long(df, {"ab": ("a", "b")}, "k").collect()
    assert len(rows) == 2 * n
    for feature in ("a", "b"):
        found = [r for r in rows if r["feature"] == feature]
        assert Counter(r["value"] for r in found) == Counter(r["permuted_value"] for r in found)
        assert sum(r["value"] == r["permuted_value"] for r in found if r["value"] is not None) < n // 100


def test_fits_share_one_layout(spark):
    """A laid-out table is read as it lies, and its forest is the one of a
    table that every fit moves and sorts for itself."""
    df = spark.range(500).select(
        F.col("id").alias("row_id"), (F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
        ((F.col("id") % 13 > 5) | (F.col("id") % 7 == 2)).cast("int").alias("Label"),
    )
    laid = ML.laid_out(df)
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    for balanced in (True, False):
        cfg = ML.ForestConfig(("a", "b"), num_trees=3, max_depth=4, balanced=balanced)
        own = ML.forest_of(ML.fit_forest(df, cfg)).toDebugString
        shared = ML.forest_of(ML.fit_forest(laid, replace(cfg, laid_out=True))).toDebugString
        assert own.split("\n", 1)[1] == shared.split("\n", 1)[1]
