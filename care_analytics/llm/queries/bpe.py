"""op7: byte-level BPE over the whole of ``documents``, encoded and decoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from care_analytics.llm.bpe import round_trip

RANKS = "byte_bpe_multi_50k.tiktoken"


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(RANKS)) \
        .select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
SQL: dict[str, str] = {}
