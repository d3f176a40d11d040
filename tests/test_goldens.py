"""Hand-made cases from FIXTURES.md §4."""

import math

import pytest
from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.functions.names import canonical_name, canonicalize
from flowlens.functions.numeric import coerce_number, parse_thresholds
from flowlens.operators import metrics as M
from flowlens.operators import profile as P
from flowlens.operators import sampling as S

LABELS = [
    ("BENIGN", "benign", "Benign", 0, "Benign", "Benign"),
    (" DDoS ", "ddos", "DDoS", 1, "Other", "Other"),
    ("DDoS attacks-LOIC-HTTP", "ddos attacks loic http", "DDoS", 1, "Other", "Other"),
    ("DDOS attack-HOIC", "ddos attack hoic", "DDoS", 1, "Other", "Other"),
    ("DoS Hulk", "dos hulk", "DoS", 1, "Other", "Other"),
    ("DoS attacks-SlowHTTPTest", "dos attacks slowhttptest", "DoS", 1, "Other", "Other"),
    ("slowloris", "slowloris", "DoS", 1, "Other", "Other"),
    ("GoldenEye", "goldeneye", "DoS", 1, "Other", "Other"),
    ("DoS", "dos", "Other", 1, "Other", "Other"),
    ("FTP-Patator", "ftp patator", "BruteForce", 1, "BruteForce", "Other"),
    ("SSH-Bruteforce", "ssh bruteforce", "BruteForce", 1, "BruteForce", "Other"),
    ("SSH Brute Force", "ssh brute force", "BruteForce", 1, "Other", "Other"),
    ("Web Attack \x96 Brute Force", "web attack brute force", "WebAttack", 1, "Other", "WebAttack"),
    ("Web Attack \x96 XSS", "web attack xss", "WebAttack", 1, "Other", "WebAttack"),
    ("Web Attack \x96 Sql Injection", "web attack sql injection", "Other", 1, "Other", "Other"),
    ("Brute Force -Web", "brute force web", "WebAttack", 1, "Other", "Other"),
    ("Brute Force -XSS", "brute force xss", "WebAttack", 1, "Other", "Other"),
    ("BruteForce-Web", "bruteforce web", "Other", 1, "Other", "WebAttack"),
    ("SQL Injection", "sql injection", "Other", 1, "Other", "Other"),
    ("SuperXSS", "superxss", "Other", 1, "Other", "Other"),
    ("PortScan", "portscan", "Other", 1, "Other", "Other"),
    (None, "nan", "Other", 1, "Other", "Other"),
    ("Label", "label", "Other", 1, "Other", "Other"),
]


def test_label_taxonomy(spark):
    df = spark.createDataFrame([(r[0],) for r in LABELS], "raw string")
    got = df.select(
        L.normalize_label(F.col("raw")), L.attack_family(F.col("raw")),
        L.binary_from_family(L.attack_family(F.col("raw"))), L.bruteforce_map(F.col("raw")), L.web_attack_map(F.col("raw")),
    ).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in LABELS]


def test_portscan_map(spark):
    df = spark.createDataFrame([("PortScan",), ("port scan",), ("BENIGN",), ("Bot",)], "raw string")
    assert [r[0] for r in df.select(L.portscan_map(F.col("raw"))).collect()] == ["PortScan", "PortScan", "Benign", "Other"]


def test_headers():
    assert canonical_name(" Destination Port") == canonical_name("Dst Port") == "dst_port"
    assert canonical_name("Init_Win_bytes_forward") == canonical_name("Init Fwd Win Byts") == "init_fwd_win_byts"
    assert canonical_name("act_data_pkt_fwd") == "fwd_act_data_pkts"
    assert canonical_name("Flow Bytes/s") == canonical_name("Flow Byts/s") == "flow_byts_s"
    assert canonical_name("min_seg_size_forward") == "fwd_seg_size_min"
    assert canonical_name("CWE Flag Count") == "cwe_flag_count"
    assert canonical_name("CWE Flag Cnt") == "cwe_flag_cnt"
    assert (canonical_name("Src IP"), canonical_name("Timestamp")) == ("src_ip", "timestamp")
    canon, keep, dups = canonicalize([" Fwd Header Length", "Label", " Fwd Header Length.1"])
    assert keep == [0, 1] and dups == ["fwd_header_len"]
    assert canonicalize(canon)[0] == canon  # idempotent


def test_cells(spark):
    cells = ["1", " 2.5", "-3", "Infinity", "-Infinity", "inf", "NaN", "", "NA", "abc", "1d", "+5", "1e3", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(coerce_number(F.col("c"))).collect()]
    exp = [1.0, 2.5, -3.0, math.inf, -math.inf, math.inf, None, None, None, None, None, 5.0, 1000.0, None]
    assert got == exp


def test_metric_numbers(spark):
    rows = [(0, 0)] * 50 + [(0, 1)] * 10 + [(1, 0)] * 5 + [(1, 1)] * 35
    df = spark.createDataFrame(rows, "y_true int, y_pred int")
    m = M.binary_metrics(df).first()
    assert m["accuracy"] == 0.85 and m["recall"] == 0.875
    assert m["precision"] == 35 / 45
    p, r = 35 / 45, 0.875
    assert m["f1_score"] == 2 * p * r / (p + r)
    assert m["specificity"] == 50 / 60
    zero = M.binary_metrics(spark.createDataFrame([(0, 1)], "y_true int, y_pred int").where("false")).first()
    assert [zero[c] for c in ("tn", "fp", "fn", "tp", "samples")] == [0, 0, 0, 0, 0]
    assert [zero[c] for c in ("accuracy", "precision", "recall", "f1_score", "specificity", "balanced_accuracy")] == [0.0] * 6


def test_example_falls_back_when_a_class_is_absent(spark):
    from flowlens.operators.examples import extreme_examples

    df = spark.createDataFrame(
        [("d", 1, 1, 1, 0.9), ("d", 2, 1, 0, 0.2)], "dataset string, row_id long, y_true int, y_pred int, attack_probability double"
    )
    got = {r["example"]: r["row_id"] for r in extreme_examples(df).collect()}
    assert got == {"attack": 1, "benign": 2}


def test_labels_and_numbers_strip_any_white_space(spark):
    from flowlens.functions.labels import attack_family

    df = spark.createDataFrame([("\tFTP-Patator", "\t2.5 ")], "raw string, cell string")
    r = df.select(attack_family(F.col("raw")).alias("f"), coerce_number(F.col("cell")).alias("n")).first()
    assert (r["f"], r["n"]) == ("BruteForce", 2.5)


def test_listed_files_are_asked_of_their_file_system(spark, tmp_path):
    from flowlens.sources.tables import existing_files, load_metrics

    spark.range(3).write.parquet(f"file://{tmp_path}/t")
    assert existing_files(spark, [f"file://{tmp_path}/t", f"file://{tmp_path}/no"]) == ([f"file://{tmp_path}/t"], [f"file://{tmp_path}/no"])
    with pytest.raises(FileNotFoundError):
        existing_files(spark, [f"{tmp_path}/no"], strict=True)
    assert load_metrics(spark, f"{tmp_path}/no", "v") is None
    assert load_metrics(spark, f"{tmp_path}/t", "v").count() == 3


def test_tie_and_expected_label(spark):
    df = spark.createDataFrame(
        [(0, 1, 0.5, "F")] * 3 + [(1, 1, 0.5, "F")] * 3, "y_true int, y_pred int, attack_probability double, attack_family string"
    )
    fam = M.family_stats(df).first()
    assert fam["expected_label"] == 0
    sw = M.threshold_sweep(df.withColumn("dataset", F.lit("d")), [0.5]).first()
    assert sw["tp"] == 3 and sw["fp"] == 3  # p >= t is an attack


def test_thresholds():
    assert parse_thresholds("0.1, 0.5,0.1") == [0.5, 0.1]
    with pytest.raises(ValueError):
        parse_thresholds("1.2")


def test_auc_small(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 0), (3.0, 1)], "x double, Label int")
    assert P.single_feature_auc(df, ["x"]).first()["single_feature_auc"] == 0.625
    flipped = df.withColumn("Label", 1 - F.col("Label"))
    assert P.single_feature_auc(flipped, ["x"]).first()["single_feature_auc"] == 0.625


def test_split_allocation(spark):
    rows = [(i, "A") for i in range(15)] + [(100 + i, "B") for i in range(5)]
    df = spark.createDataFrame(rows, "row_id long, s string")
    out = S.stratified_split(df, "s").where("split = 'test'").groupBy("s").count()
    assert {r["s"]: r["count"] for r in out.collect()} == {"A": 3, "B": 1}


def test_cap(spark):
    rows = [(i, "a") for i in range(30)] + [(100 + i, "b") for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, g string")
    out = S.capped_sample(df, ["g"], 50).groupBy("g").count()
    assert {r["g"]: r["count"] for r in out.collect()} == {"a": 30, "b": 50}


def test_scaler_constant_feature(spark):
    train = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    params = P.fit_scaler(train, ["x"])
    ext = spark.createDataFrame([(9.0,)], "x double")
    assert P.apply_scaler(ext, params).first()["x"] == 4.0


def test_distribution_tables_one_scan(spark):
    from flowlens.operators import distributions as D
    from flowlens.plans import views as V

    flow = V.v_flow(spark, "/root/testdata/sf0.001")
    t = D.distribution_tables(flow)
    got = {(r["table"], r["Label"], r["attack_family"], r["original_label"]): r["count"] for r in t.collect()}
    cls = {(r["Label"]): r["count"] for r in D.class_distribution(flow).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "class"} == cls
    fam = {r["attack_family"]: r["count"] for r in D.family_distribution(flow).collect()}
    assert {k[2]: v for k, v in got.items() if k[0] == "family"} == fam
    plan = t._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1


def test_sweep_plan_is_one_pruned_scan(spark):
    from flowlens.operators import metrics as M
    from flowlens.plans import views as V

    df = M.threshold_sweep(V.v_pred(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "ts" not in scan.split("]")[0] and "props" not in scan.split("]")[0]
