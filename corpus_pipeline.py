"""A training corpus from raw documents: filter, deduplicate, mix and pack.

Each stage is a function of (session, documents, data folder) that takes what the stage before it
kept. All but the last give back the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeflow.llm import mixing, packing, quality, rules, simhash
from gaugeflow.llm.common import free_name, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the threshold."""
    out = free_name(docs, "score")
    found = quality.quality_scores(docs, _labels(spark, sf_dir))
    return found.filter(quality.predicted(F.col(out)) == 1).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio."""
    out = free_name(docs, "rules")
    found = rules.quality_rules(docs, _labels(spark, sf_dir))
    return found.filter(F.col(f"{out}.kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group."""
    return simhash.one_per_group(docs).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget asks for, block by block in permuted order."""
    out = free_name(docs, "mix")
    return (mixing.mix(docs).repartition(F.col(f"{out}.block"))
            .sortWithinPartitions(f"{out}.block", f"{out}.position").select(*docs.columns))


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its bucket, its batch and its place in the batch."""
    out = free_name(docs, "pack")
    return packing.pack(docs).select(*docs.columns, f"{out}.*")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", source_mixing),
    ("length_packing", length_packing),
]

# scores of a fitted model and fingerprints are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as a table and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
