"""Guards inside plans, written shuffles, counted writes and restarted streams."""

import pytest
from pyspark.sql import functions as F

from flowlens.functions.numeric import WHITE_SPACE, coerce_number, strip_blanks
from flowlens.operators import clean as C
from flowlens.operators import guards as G
from flowlens.operators import metrics as M
from flowlens.operators import sampling as S
from flowlens.operators import sets as ST
from flowlens.plans import views as V
from flowlens.sources import tables as T
from flowlens.streaming import flows as SF

SF_DIR = "/root/testdata/sf0.001"
FEATURES = ("c_value", "c_user", "c_k")


def refuses(message, df):
    with pytest.raises(Exception, match=message):
        df.collect()


def test_required_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "f string")
    assert [tuple(r) for r in G.required_counts(df, "f", ["a"]).collect()] == [("a", 2)]
    refuses("no rows with f = b", G.required_counts(df, "f", ["a", "b"]))
    refuses("no rows with f = a", G.required_counts(df.limit(0), "f", ["a"]))


def test_two_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "y int")
    got = {r["y"]: (r["count"], r["weight"]) for r in G.two_class_weights(df, "y").collect()}
    assert got == {0: (3, 4 / 6), 1: (1, 2.0)}
    refuses("two classes needed in y, found 1", G.two_class_weights(df.where("y = 0"), "y"))
    refuses("two classes needed in y, found 0", G.two_class_weights(df.limit(0), "y"))


def test_paired(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, 0.5), (2, 0.1)], "k int, b double")
    assert sorted(map(tuple, ST.paired(a, b, "k").collect())) == [(1, "x", 0.5), (2, "y", 0.1)]
    for left, right, key in ((a, b.where("k = 1"), 2), (a.where("k = 2"), b, 1), (a.limit(0), b, "[12]")):
        refuses(f"rows without a partner, k = {key}", ST.paired(left, right, "k"))
        # nor may a filter on top of it hide the missing partner at planning
        refuses("rows without a partner", ST.paired(left, right, "k").where("b > 0 and a is not null"))
    assert ST.paired(a.limit(0), b.limit(0), "k").count() == 0


def test_strict_numbers(spark):
    df = spark.createDataFrame([(" 1.5", "NA"), ("-inf", "")], "a string, b string")
    assert [tuple(r) for r in C.coerce_columns(df, ["a", "b"], strict=True).collect()] == [(1.5, None), (float("-inf"), None)]
    refuses("non-numeric cell in column b: 1d", C.coerce_columns(df.withColumn("b", F.lit("1d")), ["a", "b"], strict=True))


def test_blanks_of_any_kind(spark):
    cells = [f"{w}{v}{w}" for w in ("", " ", WHITE_SPACE, " ") for v in ("7", "-Infinity", "a b", "")]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    rows = df.select("c", strip_blanks(F.col("c")).alias("t"), F.regexp_replace("c", r"^\s+|\s+$", "").alias("want"), coerce_number(F.col("c")).alias("n"))
    for r in rows.collect():
        assert r["t"] == r["want"]
        plain = r["c"].strip(WHITE_SPACE)
        assert r["n"] == {"7": 7.0, "-Infinity": float("-inf")}.get(plain)
    part = spark.createDataFrame([("\tDDoS\r\n",), ("Benign",)], "Label string")
    assert ST.class_union([(part, "ddos", "DDoS")]).count() == 1


def test_sweep_tables_are_ordered(spark):
    pred = V.v_pred(spark, SF_DIR)
    sweep = [(r["dataset"], -r["threshold"]) for r in M.threshold_sweep(pred).collect()]
    assert sweep == sorted(sweep)
    family = [(r["dataset"], -r["threshold"], r["attack_family"]) for r in M.threshold_sweep_by_family(pred).collect()]
    assert family == sorted(family)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_written_shuffle(spark, tmp_path, parts):
    df = spark.range(500).select((F.col("id") % 400).alias("row_id"), F.lit("x").alias("position_name"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        written = S.written_shuffle(df, f"file://{tmp_path}/s")
        placed = S.shuffle_positions(written).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r["position"] for r in placed] == list(range(500))
    order = [r["shuffle_order"] for r in placed]
    assert order == sorted(order) and [r["row_id"] for r in placed] != sorted(r["row_id"] for r in placed)
    # files in another order than their keys are refused
    written.orderBy(F.desc("shuffle_order")).repartitionByRange(3, F.desc("shuffle_order")).write.parquet(f"file://{tmp_path}/d")
    with pytest.raises(Exception, match="not in shuffle order"):
        S.shuffle_positions(spark.read.parquet(f"file://{tmp_path}/d")).collect()
    assert S.shuffle_positions(S.written_shuffle(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_counted_write(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int").repartition(3)
    table, seen = T.write_counted(df, f"file://{tmp_path}/t", {"one": F.col("x") == 1, "more": F.col("x") > 5})
    assert seen == {"rows": 3, "one": 1, "more": 0} and table.count() == 3
    assert T.write_counted(df.limit(0), f"file://{tmp_path}/u", {"one": F.col("x") == 1})[1] == {"rows": 0, "one": 0}


def test_stream_killed_between_rows_and_report(spark, tmp_path, monkeypatch):
    """A job that dies after the rows of its third batch, run again."""
    raw = V.v_raw(spark, SF_DIR).select("source_file", "source_row", "label", *FEATURES)
    base = f"file://{tmp_path}"
    raw.repartition(4, "source_row").write.parquet(f"{base}/in")

    def drain():
        stream = SF.read_stream(spark, f"{base}/in", raw.schema)
        SF.drain_reported(SF.marked_rows(stream, FEATURES, keep=("source_file", "source_row")), f"{base}/out", f"{base}/progress")

    whole, calls = SF.batch_report, []

    def dies(rows, file_col):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return whole(rows, file_col)

    monkeypatch.setattr(SF, "batch_report", dies)
    with pytest.raises(Exception, match="killed"):
        drain()
    assert len(calls) == 3
    monkeypatch.setattr(SF, "batch_report", whole)
    drain()
    drain()  # nothing new: nothing changes
    rows = spark.read.parquet(f"{base}/out/rows")
    want = SF.marked_rows(raw, FEATURES, keep=("source_file", "source_row"))
    columns = ["source_file", "source_row", "attack_family", *FEATURES, "Label", "status"]
    assert rows.count() == want.count()
    assert rows.select(*columns).exceptAll(want.select(*columns)).count() == 0
    report = spark.read.parquet(f"{base}/out/report")
    assert report.select("batch").distinct().count() == 4
    assert report.count() == report.select("batch", "source_file").distinct().count()
    assert report.agg(F.sum("rows_before")).first()[0] == raw.count()


def test_counters_go_on_after_a_restart(spark, tmp_path):
    pred = V.v_pred(spark, SF_DIR)
    base = f"file://{tmp_path}"
    keys = ["dataset", "attack_family", "threshold"]
    for part in (0, 1, None):
        if part is not None:
            pred.where(F.col("row_id") % 2 == part).repartition(2).write.mode("append").parquet(f"{base}/in")
        counts = SF.running_threshold_counts(SF.read_stream(spark, f"{base}/in", pred.schema))
        SF.drain_updates(counts, f"{base}/out", f"{base}/progress")
    got = SF.latest_values(spark, f"{base}/out", keys).select(*keys, "tn", "fp", "fn", "tp")
    want = SF.running_threshold_counts(pred).select(*keys, "tn", "fp", "fn", "tp")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(f"{base}/out").select("batch").distinct().count() == 4
