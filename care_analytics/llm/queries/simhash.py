"""op6: SimHash near-dedup over the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from care_analytics.llm.simhash import near_dedup


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_simhash": op6_simhash}
SQL: dict[str, str] = {}
