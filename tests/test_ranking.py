"""Skew-safe ranking equals the plain window for any layout and bucket size."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.operators.ranking import dense_rank_in_group, mark_top_k, seeded_order


def _data(spark, parts):
    # one hot group with most rows, a few small ones
    df = spark.range(0, 3000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 3).cast("string"))).alias("g"),
    )
    return df.repartition(parts).withColumn("_o", seeded_order(7, "row_id"))


@pytest.mark.parametrize("parts", [1, 4, 16])
@pytest.mark.parametrize("bits", [0, 3, 14])
@pytest.mark.parametrize("quota", [0, 1, 33, 500, 5000])
def test_top_k_equals_window(spark, parts, bits, quota):
    df = _data(spark, parts)
    got = {r[0] for r in mark_top_k(df, ["g"], quota, "_o", "sel", bits).where("sel").select("row_id").collect()}
    w = Window.partitionBy("g").orderBy("_o")
    exp = {r[0] for r in df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= quota).select("row_id").collect()}
    assert got == exp


@pytest.mark.parametrize("parts", [1, 4, 16])
@pytest.mark.parametrize("rows_per_bucket", [5, 64, 50000])
def test_dense_rank_equals_row_number(spark, parts, rows_per_bucket):
    df = _data(spark, parts).withColumn("k", F.col("row_id") * 3 + 11)
    got = {(r[0], r[1]) for r in dense_rank_in_group(df, ["g"], "k", "r", rows_per_bucket).select("row_id", "r").collect()}
    w = Window.partitionBy("g").orderBy("k")
    exp = {(r[0], r[1] - 1) for r in df.withColumn("rn", F.row_number().over(w)).select("row_id", "rn").collect()}
    assert got == exp


def test_global_top_k(spark):
    df = _data(spark, 4)
    got = mark_top_k(df, [], 10, "_o", "sel", 4).where("sel").count()
    assert got == 10


def test_top_k_with_many_groups_takes_the_shuffle_join(spark, monkeypatch):
    from flowlens.operators import ranking

    df = _data(spark, 4).union(_data(spark, 1).select("row_id", F.lit(None).cast("string"), "_o"))
    want = {tuple(r) for r in mark_top_k(df, ["g"], 33, "_o", "sel", 3).where("sel").select("g", "row_id").collect()}
    monkeypatch.setattr(ranking, "MAX_GROUPS_BROADCAST", 1)
    got = {tuple(r) for r in mark_top_k(df, ["g"], 33, "_o", "sel", 3).where("sel").select("g", "row_id").collect()}
    assert got == want and len(got) == 33 * 5


def test_top_k_of_no_rows(spark):
    assert mark_top_k(_data(spark, 1).where("false"), ["g"], 5, "_o", "sel").count() == 0


def test_marking_plans_one_scan_and_no_exchange_by_group(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("_o", seeded_order(7, "event_id"))
    plan = mark_top_k(df, ["event_type"], 9, "_o", "sel")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "hashpartitioning" not in plan


def test_dense_rank_with_an_outlying_key_and_a_null_group(spark):
    df = _data(spark, 4).withColumn("k", F.when(F.col("row_id") == 5, F.lit(1 << 60)).otherwise(F.col("row_id")))
    df = df.withColumn("g", F.when(F.col("g") == "g1", F.lit(None)).otherwise(F.col("g")))
    ranked = dense_rank_in_group(df, ["g"], "k", "r", 100)
    w = Window.partitionBy("g").orderBy("k")
    exp = {(r[0], r[1] - 1) for r in df.withColumn("rn", F.row_number().over(w)).select("row_id", "rn").collect()}
    assert {tuple(r) for r in ranked.select("row_id", "r").collect()} == exp
    # no stored partition holds more than a small share of the rows
    sizes = [r["n"] for r in ranked.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 500
    assert dense_rank_in_group(df.where("false"), ["g"], "k", "r").count() == 0


def test_auc_of_a_heavy_tailed_feature(spark):
    from flowlens.operators.profile import single_feature_auc

    rows = [(float(i), i % 2) for i in range(200)] + [(1e18, 1), (-1e18, 0)]
    df = spark.createDataFrame(rows, "x double, Label int")
    pos, neg = [x for x, y in rows if y], [x for x, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert single_feature_auc(df, ["x"]).first()["single_feature_auc"] == max(auc, 1 - auc)
