"""Queries of the training-data operators: thin digests of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import bisector_kmeans
from flowlens.llm.common import held_out
from flowlens.session import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@register("op3_warc_chunks")
def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import warc

    return warc.page_records(read_table(spark, sf_dir, "pages"))


@register("op4_benchmark_automaton")
def op4_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import decontaminate as dc

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found, state = dc.find_benchmark(docs, read_table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col(f"{state}.items")))
    return found.select(
        "doc_id",
        F.col(f"{state}.n_words").alias("n_words"),
        dc.n_hit(state).alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        dc.is_contaminated(state).alias("contaminated"),
    )


@register("op7_feistel_shards")
def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import feistel

    docs = read_table(spark, sf_dir, "documents")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    placed = feistel.feistel_shards(slim, ["doc_id", "size", "text_crc32"], 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )


@register("op8_voronoi_topk")
def op8_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import voronoi_topk

    return voronoi_topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@register("op9_fair_mix")
def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import fair_mix

    mix = fair_mix.fair_mix(read_table(spark, sf_dir, "documents"), share=1.5, weights=(5, 2, 1))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def _learned(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@register("op2_kneser_ney_toxicity")
def op2_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import kn_toxicity

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return _learned(kn_toxicity.score_toxicity(docs.select("doc_id", "text"), labels), 0.3)


@register("op6_rule_ensemble_quality")
def op6_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import rule_quality

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return _learned(rule_quality.score_quality(docs.select("doc_id", "text"), labels), 0.7)


@register("op10_bigru_language")
def op10_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import bigru_langid

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & (F.length("text") > 0))
    network = bigru_langid.train_network(known)
    said, at = bigru_langid.identify(docs.select("doc_id", "text"), network)
    return said.select("doc_id", held_out("doc_id").alias("held_out"), F.col(f"{at}.lang").alias("lang_pred"), F.col(f"{at}.score").alias("score"))


@register("op5_block_anchor_dedup")
def op5_block_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import block_dedup

    cleaned = block_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return cleaned.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@register("op1_order_minhash")
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import omh_dedup

    found = omh_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id")


@register("op11_bisector_kmeans", bisector_kmeans.cluster_sql())
def op11_bisector_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, _ = bisector_kmeans.cluster(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5)
    return assigned


@register("op12_license_rules")
def op12_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import license_scan as ls

    found, state = ls.find_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ls.base_detections(state)
    starts = F.transform(base, lambda d: d["first_word"])
    return found.select(
        "doc_id",
        F.col(f"{state}.n_words").alias("n_words"),
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        ls.label_list(base).alias("base_labels"),
        ls.label_list(F.col(f"{state}.detections")).alias("labels"),
        F.col(f"{state}.score").alias("score"),
    )


@register("op13_path_ranking_repair")
def op13_path_ranking_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm import conversation_repair

    report, _ = conversation_repair.repair_conversations(read_table(spark, sf_dir, "conversations"))
    return report
