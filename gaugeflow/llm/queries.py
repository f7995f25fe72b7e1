"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.llm import (collocations, conversations, exact, html, language, licenses, mixing, packing, quality, rules, sharding,
                           simhash, topk)
from gaugeflow.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.placements(docs).select(
        F.col("id").alias("doc_id"), "source", "n_tokens", "epoch", "block", "position")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), topk.sign_code(F.col("embedding")).alias("code"))
    return topk.top_k(rows, rows.filter("id % 20 = 0")).withColumnRenamed("id", "vec_id")


def op3_table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text",
                        F.char_length("text").cast("long").alias("n_chars"))


def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.quality_scores(docs, _table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        quality.predicted(F.col("score")).alias("predicted"))


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.placements(docs).select(
        F.col("id").alias("doc_id"), "n_tokens", "bucket", "bucket_length", "batch", "slot")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "license.*")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op10_likelihood_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = rules.quality_rules(docs, _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "rules.*")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.with_lost(conversations.repair(conversations.damage(rows)), rows)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_temperature_mixing, op2_exact_top_k, op3_table_sharding, op4_html_extraction,
        op5_attention_quality, op6_length_buckets, op7_license_scan, op8_language_id,
        op9_simhash_near_dedup, op10_likelihood_rules, op11_exact_dedup, op12_conversation_repair,
        op13_phrase_collocations)
}
ORACLES: dict[str, str] = {
    "op1_temperature_mixing": mixing.oracle(),
    "op2_exact_top_k": topk.oracle(),
    "op3_table_sharding": sharding.oracle(),
    "op6_length_buckets": packing.oracle(),
    "op7_license_scan": licenses.oracle(),
    "op11_exact_dedup": exact.oracle(),
    "op12_conversation_repair": conversations.oracle(),
    "op13_phrase_collocations": collocations.oracle(),
}
