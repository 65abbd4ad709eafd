"""op9: license notices in the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from care_analytics.llm.licenses import scan


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_license_scan": op9_license_scan}
SQL: dict[str, str] = {}
