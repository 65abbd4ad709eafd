"""Bundles -> twelve warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.flatten import FLATTENERS, flatten
from ..schemas import TABLE_OF
from ..sources.bundles import bundle_entries, read_bundles, resources
from ..sources.warehouse import Warehouse


def tables(entries: DataFrame, grain: str = "line") -> dict[str, DataFrame]:
    """The twelve flat tables as lazy frames, keyed by table name."""
    return {TABLE_OF[t]: flatten(resources(entries, t), FLATTENERS[t], grain=grain)
            for t in TABLE_OF}


def run(spark: SparkSession, input_path: str, output_root: str, ndjson: bool = False,
        num_partitions: int | None = None, grain: str = "line", merge: bool = False) -> list[str]:
    """Read bundles, flatten all resource types, write one Parquet folder each."""
    entries = bundle_entries(read_bundles(spark, input_path, ndjson=ndjson,
                                          num_partitions=num_partitions), keep_corrupt=True)
    return Warehouse(spark, output_root).build(entries, grain=grain, merge=merge)
