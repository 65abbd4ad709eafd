"""op2: every page written to WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from care_analytics.llm.common import scratch_path
from care_analytics.llm.warc import read_archives, write_archives


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    gap = F.raise_error(F.concat(F.lit("page lost, "), "reason", F.lit(" at byte "), F.col("offset").cast("string"), F.lit(" of "), "path")).cast("string")
    return read_archives(spark, path, payloads=False) \
        .select(F.when(F.col("reason").isNull(), F.col("record_id")).otherwise(gap).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                F.col("refers_to").cast(kind).alias("refers_to"))


QUERIES = {"op2_warc": op2_warc}
SQL: dict[str, str] = {}
