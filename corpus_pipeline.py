"""Training-data pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``.

1. ``quality``: rejects documents whose rule-ensemble score is below 0.7.
2. ``near_dedup``: one document (the smallest id) of each Order MinHash class.
3. ``decontaminate``: rejects documents of which a twentieth of the words or
   more lies in benchmark phrases.
4. ``mix``: weighted fair queueing over sources; a document is there once for
   each pass that takes words of it, the last one of a source cut to its share.
5. ``shard``: Feistel permutation into eight shards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, fair_mix, feistel, omh_dedup, rule_quality
from flowlens.llm.common import shared_dir
from flowlens.session import read_table

QUALITY_THRESHOLD = 0.7
SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_quality.keep_quality(docs, read_table(spark, sf_dir, "labels"), QUALITY_THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return omh_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fair_mix.mixed_documents(docs, share=1.5, weights=(5, 2, 1))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    return feistel.feistel_shards(slim, ["doc_id", "size", "text_crc32"], SHARDS)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("mix", mix),
    ("shard", shard),
]

# Models and sketches have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
