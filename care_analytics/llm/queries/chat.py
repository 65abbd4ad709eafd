"""op1: the whole of ``conversations`` as plain transcripts, roles recovered and turns rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from care_analytics.llm.chat import format_chat, transcribe


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per transcript line; learned from conversations whose crc32(conv_id) mod 4 is not 2."""
    lines = transcribe(spark.read.parquet(f"{sf_dir}/conversations.parquet")) \
        .withColumn("held_out", F.coalesce(F.crc32(F.col("conv").cast("string")) % 4 == 2, F.lit(False))) \
        .withColumn("learn", ~F.col("held_out"))
    return format_chat(lines, "conv", ["turn", "place", "line"], "text", "role", "opens", "learn") \
        .select(F.col("conv").alias("conv_id"), "turn", "line", "held_out", "role", "opens", "role_pred", "opens_pred", "rendered")


QUERIES = {"op1_chat_formatting": op1_chat_formatting}
SQL: dict[str, str] = {}
