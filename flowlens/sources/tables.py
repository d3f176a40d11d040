"""Table sources and sinks between steps (SRC-5/6, SRC-8..16, PRJ-7, PRJ-10).

Parquet replaces the CSV hand-off files; writes are single distributed
writes (overwrite = idempotent rebuild, append = incremental). Nothing here
moves rows through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.names import require_columns

METADATA_COLUMNS = ("dataset", "source_file", "source_row", "original_label", "attack_family")
NON_FEATURE_COLUMNS = {"label", "Label", *METADATA_COLUMNS}


def load_table(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """SRC-9: read a step's table; error naming every missing column."""
    df = spark.read.parquet(path)
    require_columns(df.columns, list(required), path)
    return df


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """SRC-11/12/13/14: one distributed write; ``partition_by=('source_file',)``
    gives the per-file outputs of the legacy flow."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_counted(df: DataFrame, path: str, counts: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """SRC-11 with AGG-2/AGG-3: writes ``df`` and counts, in the same pass, the
    rows for which each named condition holds; (stored table, counts).

    The counters are observed in the write's own stage, where a task that is
    run again counts once; their number is the caller's, not the data's."""
    seen = Observation()
    sums = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"n{i}") for i, c in enumerate(counts.values())]
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *sums)
    write_table(watched, path)
    got = seen.get
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table, {"rows": int(got["rows"]), **{name: int(got[f"n{i}"]) for i, name in enumerate(counts)}}


def split_roles(columns: Sequence[str], label: str = "Label") -> tuple[list[str], str, list[str]]:
    """PRJ-7: feature, label and metadata column names of a prepared table."""
    feats = [c for c in columns if c not in NON_FEATURE_COLUMNS]
    meta = [c for c in METADATA_COLUMNS if c in columns]
    return feats, label, meta


def existing_files(spark: SparkSession, paths: Sequence[str], strict: bool = False) -> tuple[list[str], list[str]]:
    """SRC-5/SRC-6: (present, absent) of the listed files, asked of the file
    system each path names (hdfs, s3a, file ...); ``strict`` refuses absent ones."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = {p: (at := hadoop(p)).getFileSystem(conf).exists(at) for p in paths}
    absent = [p for p in paths if not there[p]]
    if strict and absent:
        raise FileNotFoundError(f"no such input: {', '.join(absent)}")
    return [p for p in paths if there[p]], absent


def load_metrics(spark: SparkSession, path: str, variant: str) -> DataFrame | None:
    """SRC-10: a metrics table tagged with its variant, None when absent. Any
    other trouble (damaged file, no access) is raised."""
    if existing_files(spark, [path])[1]:
        return None
    return spark.read.parquet(path).withColumn("variant", F.lit(variant))


def save_feature_list(spark: SparkSession, features: Sequence[str], path: str) -> None:
    """SRC-15: the ordered feature list as a small table (position, feature)."""
    spark.createDataFrame(list(enumerate(features)), "position int, feature string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(path)


def load_feature_list(spark: SparkSession, path: str) -> list[str]:
    return [r["feature"] for r in spark.read.parquet(path).orderBy("position").collect()]


def save_scaler(spark: SparkSession, params: dict[str, tuple[float, float]], path: str) -> None:
    """SRC-16: scaler parameters as a small table (feature, mean, scale)."""
    rows = [(f, mean, scale) for f, (mean, scale) in params.items()]
    spark.createDataFrame(rows, "feature string, mean double, scale double").coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (r["mean"], r["scale"]) for r in spark.read.parquet(path).collect()}


def drop_non_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PRJ-10: drop columns whose non-missing cells are not all numbers."""
    from flowlens.operators.clean import numeric_columns

    keep = set(numeric_columns(df, columns))
    return df.drop(*[c for c in columns if c not in keep])
