"""The queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, decontaminate, fim_rope, hyperminhash, jump_shards, packing, pii, quality_llr, resync, secrets_markov, tokens, toxicity, url_lists, word_ids
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return url_lists.decide(url_lists.sample_captures(pages), url_lists.sample_entries(pages))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.scan(docs, pii.fit(docs))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.occurrences(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secrets_markov.scan(docs, secrets_markov.fit(docs))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_llr.judge(docs, quality_llr.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokens.default_path("byte_bpe_50k.json"))


def op8_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.shard(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_bit_plane_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokens.default_path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_ids.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = resync.counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokens.default_path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim_rope.restore(fim_rope.transform(table(spark, sf_dir, "documents", "doc_id", "text")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_url_list_filter": op1_url_list_filter,
        "op2_pii": op2_pii,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_secret_scan": op4_secret_scan,
        "op5_quality_rules": op5_quality_rules,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_toxicity": op7_toxicity,
        "op8_jump_hash_sharding": op8_jump_hash_sharding,
        "op9_bit_plane_token_files": op9_bit_plane_token_files,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_token_counts": op12_token_counts,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_list_filter": url_lists.ORACLE,
        "op8_jump_hash_sharding": jump_shards.ORACLE,
        "op11_importance_resampling": word_ids.ORACLE,
        "op13_fill_in_middle": fim_rope.ORACLE,
    }
