"""op5: benchmark decontamination over the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from care_analytics.llm.decontaminate import decontaminate


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op5_decontamination": op5_decontamination}
SQL: dict[str, str] = {}
