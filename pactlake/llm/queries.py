"""Registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm import decontaminate, hard_negatives, language_id, license_scan, lm_score, mixing, ngram_join, repeats, sharding, source_audit, token_counts, topk_search, url_filter
from pactlake.llm.common import table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_words(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.drawn(docs).select("row.doc_id", "row.source", F.col("tokens").alias("n_tokens"), F.round("exponent", 6).alias("exponent"), F.round("weight", 6).alias("weight"), "block", F.col("key").alias("block_key"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_topk_search": op6_topk_search,
    "op7_decontaminate": op7_decontaminate,
    "op8_repeats": op8_repeats,
    "op9_url_filter": op9_url_filter,
    "op10_ngram_join": op10_ngram_join,
    "op11_source_audit": op11_source_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
}

ORACLES = {
    "op3_license_scan": license_scan.oracle(),
    "op4_mixing": mixing.oracle(),
    "op6_topk_search": topk_search.oracle(),
    "op7_decontaminate": decontaminate.oracle(),
    "op9_url_filter": url_filter.oracle(),
    "op10_ngram_join": ngram_join.oracle(),
    "op11_source_audit": source_audit.oracle(),
    "op12_hard_negatives": hard_negatives.oracle(),
}
