"""op4: later repeated runs of lines in the whole of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from care_analytics.llm.line_dedup import dedup_lines


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")) \
        .select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
SQL: dict[str, str] = {}
