"""Corpus pipeline over ``documents``: five operators, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads again for the next. All but the last return the
columns of documents. Rows with null or empty text go at the first stage (no letter, no language). Rows are kept and dropped by id
and text, so rows that share an id, or have none, are judged each for itself; a null id comes after all others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from care_analytics.llm import bpe, decontaminate, exact_dedup, language, simhash
from care_analytics.llm.common import drop_rows, keep_rows, row_key, written

RANKS = "byte_bpe_multi_50k.tiktoken"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no learned language stands out, go."""
    return language.accepted(docs, language.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the largest doc_id stays."""
    return exact_dedup.distinct_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints, the one with the smallest doc_id stays (of rows that share it, the one of
    smallest text hash)."""
    keyed = docs.select(row_key(docs).alias("__row"), docs["text"].alias("__text"))
    first = simhash.near_dedup(keyed, "__row", "__text").filter(F.col("__row") == F.col("component_id"))
    return keep_rows(docs, first.select(F.col("__row").alias("__keep")).distinct())


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    keyed = docs.select(row_key(docs).alias("__row"), docs["text"].alias("__text"))
    leaks = decontaminate.matches(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__row", "__text")
    return drop_rows(docs, leaks.select(F.col("__id").alias("__drop")).distinct())


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids (little-endian unsigned 32-bit), their number, and the digests of ids and decoded bytes."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("language", known_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("tokenize", tokenize),
]

# Language prediction, fingerprints, templates and token merging are not SQL: tests/llm checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
