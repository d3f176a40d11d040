"""Surrogate views that give the driver's tables the shapes the study works on.

The study reads labelled flow captures; the driver ships TPC-H-like tables.
Each view below is a lazy projection of one table (no data leaves Spark), so
every registered query's work grows with the table it reads. The same views
are written in DuckDB SQL in ``flowlens.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.session import read_table

# Which event type plays which attack family in the surrogate.
EVENT_FAMILY = (
    ("view", "Benign"),
    ("click", "DDoS"),
    ("purchase", "DoS"),
    ("signup", "BruteForce"),
    ("error", "WebAttack"),
)

# Raw label texts spread over the events (dash 0x96 as in the
# latin1 web-attack labels; None is an empty cell; 'Label' a repeated header).
RAW_LABELS = (
    "BENIGN",
    " DDoS ",
    "DDoS attacks-LOIC-HTTP",
    "DDOS attack-HOIC",
    "DoS Hulk",
    "DoS attacks-SlowHTTPTest",
    "slowloris",
    "GoldenEye",
    "DoS",
    "FTP-Patator",
    "SSH-Bruteforce",
    "SSH Brute Force",
    "Web Attack \x96 Brute Force",
    "Web Attack \x96 XSS",
    "Web Attack \x96 Sql Injection",
    "Brute Force -Web",
    "Brute Force -XSS",
    "BruteForce-Web",
    "SQL Injection",
    "SuperXSS",
    "PortScan",
    "port scan",
    "Bot",
    "Heartbleed",
    "Infiltration",
    None,
    "Label",
    "Benign",
    "ftp-bruteforce",
    "DoS slowloris",
)


def event_family(event_type: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for event, family in EVENT_FAMILY:
        expr = expr.when(event_type == event, F.lit(family))
    return expr.otherwise(F.lit("Other"))


def v_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: row key, dataset, metadata, ``y_true``, ``y_pred``, probability."""
    e = read_table(spark, sf_dir, "events")
    family = event_family(F.col("event_type"))
    prob = F.col("value") / F.lit(500.0)
    return e.select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("user_id") % 2 == 0, F.lit("internal")).otherwise(F.lit("external")).alias("dataset"),
        F.concat(F.lit("part-"), (F.col("user_id") % 8).cast("string")).alias("source_file"),
        F.col("event_id").alias("source_row"),
        F.col("event_type").alias("original_label"),
        family.alias("attack_family"),
        L.binary_from_family(family).alias("y_true"),
        prob.alias("attack_probability"),
        F.when(prob > F.lit(0.5), F.lit(1)).otherwise(F.lit(0)).cast("int").alias("y_pred"),
    )


FLOW_FEATURES = ("value", "user_id", "hour", "k")


def v_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared flows: four DOUBLE features, ``Label`` and the metadata columns."""
    e = read_table(spark, sf_dir, "events")
    family = event_family(F.col("event_type"))
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("value").cast("double").alias("value"),
        F.col("user_id").cast("double").alias("user_id"),
        F.hour("ts").cast("double").alias("hour"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        L.binary_from_family(family).alias("Label"),
        F.when(F.col("user_id") % 2 == 0, F.lit("internal")).otherwise(F.lit("external")).alias("dataset"),
        F.concat(F.lit("part-"), (F.col("user_id") % 8).cast("string")).alias("source_file"),
        F.col("event_id").alias("source_row"),
        F.col("event_type").alias("original_label"),
        family.alias("attack_family"),
    )


RAW_FEATURES = ("c_value", "c_user", "c_hour", "c_k", "c_text", "c_sparse")


def _raw_label(row_key: Column) -> Column:
    labels = F.array(*[F.lit(x).cast("string") for x in RAW_LABELS])
    return F.element_at(labels, (row_key % len(RAW_LABELS) + 1).cast("int"))


def v_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text cells as a CSV reader would see them, bad cells injected."""
    e = read_table(spark, sf_dir, "events")
    i = F.col("event_id")
    hour = F.hour("ts").cast("string")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.concat(F.lit("part-"), (F.col("user_id") % 8).cast("string")).alias("source_file"),
        i.alias("source_row"),
        _raw_label(i).alias("label"),
        F.when(i % 97 == 0, "Infinity").when(i % 83 == 0, "NaN").otherwise(F.col("value").cast("string")).alias("c_value"),
        F.when(i % 89 == 0, "-Infinity").when(i % 79 == 0, "").otherwise(F.col("user_id").cast("string")).alias("c_user"),
        F.when(i % 73 == 0, "abc").when(i % 71 == 0, " 2.5").when(i % 67 == 0, "1d").otherwise(hour).alias("c_hour"),
        F.when(i % 61 == 0, "NA").when(i % 59 == 0, "inf").when(i % 53 == 0, "+5").when(i % 47 == 0, "1e3").otherwise(k).alias("c_k"),
        F.concat(F.lit("x"), (i % 3).cast("string")).alias("c_text"),
        F.when(F.col("user_id") % 8 == 3, F.lit(None).cast("string")).otherwise((i % 5).cast("string")).alias("c_sparse"),
    )


def v_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("row_id"), _raw_label(F.col("event_id")).alias("raw_label"))


LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def v_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train/test-matrix stand-in: four features, 0/1 label, a unique row key."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        *LINE_KEY[:4],
        "l_shipdate",
        *LINE_FEATURES,
        "l_returnflag",
        F.when(F.col("l_returnflag") == "R", F.lit(1)).otherwise(F.lit(0)).cast("int").alias("label"),
        F.concat_ws(
            "|",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.col("l_extendedprice").cast("string"),
            F.date_format("l_shipdate", "yyyy-MM-dd"),
        ).alias("row_key"),
    )


DOC_FEATURES = ("n_chars", "n_lines", "n_digits", "n_upper")


def v_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⋈ labels: integer text statistics and the quality label."""
    d = read_table(spark, sf_dir, "documents")
    lab = read_table(spark, sf_dir, "labels")
    t = F.col("text")
    feats = d.select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "\n", "")) + 1).cast("double").alias("n_lines"),
        F.length(F.regexp_replace(t, "[^0-9]", "")).cast("double").alias("n_digits"),
        F.length(F.regexp_replace(t, "[^A-Z]", "")).cast("double").alias("n_upper"),
        F.col("source"),
        F.col("lang"),
    )
    return feats.join(lab.select("doc_id", F.col("quality").cast("int").alias("label"), "toxic"), "doc_id", "inner")
