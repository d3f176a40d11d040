"""Structured Streaming forms of the chunked jobs (STR-1..3).

The original processes big captures chunk by chunk with running counters.
Here a file-source stream is scored statelessly and appended to a file sink
(STR-1), and the counters are a streaming aggregate whose state is bounded by
(dataset × threshold × family) keys (STR-2/3), so no watermark is needed.
``trigger(availableNow=True)`` drains what is there, in micro-batches, with
checkpointed progress: a restarted job resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowlens.functions import labels as L
from flowlens.functions.numeric import DEFAULT_THRESHOLDS, coerce_number, is_finite, parse_thresholds
from flowlens.operators.model import score
from flowlens.operators.profile import apply_scaler


def read_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 1) -> DataFrame:
    """Parquet files arriving in ``path`` as a stream (explicit schema)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_scores(stream: DataFrame, model: PipelineModel, label: str = "Label") -> DataFrame:
    """STR-1: stateless scoring of every arriving row."""
    return score(model, stream, label)


def stream_prepared_scores(
    stream: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    params: dict[str, tuple[float, float]],
    label: str = "label",
    keep: Sequence[str] = (),
) -> DataFrame:
    """STR-1 on raw text rows: family filter, coercion, finite rows only, the
    training scaler, scores. Row by row, so it is the same in batch."""
    family = stream.withColumn("_family", L.normalize_label(F.col(label))).withColumn("attack_family", L.family_of(F.col("_family")))
    known = family.where(F.col("attack_family").isin(*L.INCLUDED_FAMILIES))
    numbers = known.select(*keep, "attack_family", *[coerce_number(F.col(c)).alias(c) for c in features])
    for c in features:
        numbers = numbers.where(is_finite(F.col(c)))
    numbers = numbers.withColumn("Label", L.binary_from_family(F.col("attack_family")))
    return score(model, apply_scaler(numbers, params))


def marked_rows(stream: DataFrame, features: Sequence[str], label: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """STR-1 on raw text rows, no row left out: numbers, family, ``Label`` and
    ``status``: 'label' (family not studied), 'cell' (a number missing or not
    finite) or 'clean'. Row by row, so it is the same in batch."""
    family = L.family_of(L.normalize_label(F.col(label)))
    rows = stream.select(*keep, family.alias("attack_family"), *[coerce_number(F.col(c)).alias(c) for c in features])
    finite = F.lit(True)
    for c in features:
        finite = finite & is_finite(F.col(c))
    studied = F.coalesce(F.col("attack_family").isin(*L.INCLUDED_FAMILIES), F.lit(False))
    status = F.when(~studied, "label").when(finite, "clean").otherwise("cell")
    return rows.withColumn("Label", L.binary_from_family(F.col("attack_family"))).withColumn("status", status)


def batch_report(rows: DataFrame, file_col: str = "source_file") -> DataFrame:
    """AGG-3 of marked rows: per file the rows before and after each filter."""
    n = lambda c: F.count_if(c).cast("bigint")
    return rows.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("rows_before"),
        n(F.col("status") != "label").alias("rows_after_label_filter"),
        n(F.col("status") == "clean").alias("rows_after_cleaning"),
    )


def drain_reported(marked: DataFrame, folder: str, checkpoint: str, file_col: str = "source_file") -> None:
    """STR-1 sink with a report per batch, safe to restart.

    Every batch owns the folders ``rows/batch=N`` (split by status) and
    ``report/batch=N`` and overwrites them. The checkpoint's log gives a batch
    that is run again the same number and the same files, so a job that dies
    between the two writes leaves no row and no report row twice."""
    spark = marked.sparkSession
    schema = marked.schema

    def put(batch: DataFrame, number: int) -> None:
        rows = f"{folder}/rows/batch={number}"
        batch.write.mode("overwrite").partitionBy("status").parquet(rows)
        report = batch_report(spark.read.schema(schema).parquet(rows), file_col)
        report.write.mode("overwrite").parquet(f"{folder}/report/batch={number}")

    marked.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_updates(counts: DataFrame, folder: str, checkpoint: str) -> None:
    """STR-2/STR-3 sink that goes on where an earlier drain ended: the groups a
    batch changed are written, with their running values, under its number.

    The values come from the state of the checkpoint, so files that arrive
    later only add to them; a batch that is run again overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def latest_values(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of every group of a ``drain_updates`` folder."""
    table = spark.read.option("basePath", folder).parquet(folder)
    values = [c for c in table.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), F.col("batch").cast("bigint")).alias("_v")
    return table.groupBy(*keys).agg(newest).select(*keys, "_v.*")


def running_threshold_counts(
    scored: DataFrame,
    thresholds: Sequence[float] = DEFAULT_THRESHOLDS,
    group_by: Sequence[str] = ("dataset", "attack_family"),
    y_true: str = "y_true",
    prob: str = "attack_probability",
) -> DataFrame:
    """STR-2: running tn/fp/fn/tp per threshold and group.

    One row of state per group with two sums for each threshold; rows are not
    replicated. The few result rows are turned to one per threshold after the
    aggregate.
    """
    cuts = parse_thresholds(list(thresholds))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    t, p = F.col(y_true), F.col(prob)
    sums = [n(t == 0).alias("_neg"), n(t == 1).alias("_pos")]
    for i, cut in enumerate(cuts):
        sums += [n((t == 0) & (p >= F.lit(cut))).alias(f"_fp{i}"), n((t == 1) & (p >= F.lit(cut))).alias(f"_tp{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(cut).alias("threshold"),
                (F.col("_neg") - F.col(f"_fp{i}")).alias("tn"),
                F.col(f"_fp{i}").alias("fp"),
                (F.col("_pos") - F.col(f"_tp{i}")).alias("fn"),
                F.col(f"_tp{i}").alias("tp"),
            )
            for i, cut in enumerate(cuts)
        ]
    )
    return scored.groupBy(*group_by).agg(*sums).select(*group_by, F.explode(rows).alias("_r")).select(*group_by, "_r.*")


def running_counts(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """STR-3: running class / family / label counts."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def drain_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Run a streaming query to completion (availableNow) into a memory table."""
    q = (
        df.writeStream.outputMode(mode)
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def drain_to_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """STR-1 sink: append scored rows as Parquet, exactly once per file."""
    q = (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
