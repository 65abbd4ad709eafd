"""op10: personal data in the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from care_analytics.llm.pii import KINDS, joined, marked


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sanitized_sha256`` is the digest of the text with its entities and revealing terms generalised or removed."""
    rows = marked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("__id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                       F.sha2(joined(KINDS), 256).alias("base_sha256"), joined([*KINDS, "term"]).alias("spans"),
                       F.size("term").cast("long").alias("n_term"), F.coalesce(F.sha2("__clean", 256), "__sha").alias("sanitized_sha256"))


QUERIES = {"op10_pii": op10_pii}
SQL: dict[str, str] = {}
