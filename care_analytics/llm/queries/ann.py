"""op11: the 20 nearest rows of every twentieth row of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from care_analytics.llm.ann import search


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "__id % 20 = 0", 20)


QUERIES = {"op11_nearest_neighbours": op11_nearest_neighbours}
SQL: dict[str, str] = {}
