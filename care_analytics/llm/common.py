"""Helpers the operators share: shared scratch tables, row selection by id, components.

Every operator first projects its input to the columns it needs under names
that start with ``__``, so further input columns, whatever their names, never clash.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (``spark.checkpoint.dir``).

    Unset is allowed in local mode only (tests), where a folder is made; on a
    cluster an unset folder is an error, because a local one would not be seen
    by other executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="care-shared-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder name in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key of a row: its id and the hash of its text, so that rows that share an id are told apart. Null ids sort last."""
    return F.struct(docs[id_col].isNull().alias("n"), docs[id_col].alias("i"), F.xxhash64(text_or_empty(docs[text_col])).alias("h"))


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is in ``keys.__keep``. The keys grow with the documents, so the
    join is a merge at every size."""
    return docs.join(keys.hint("merge"), _same(docs, keys["__keep"]), "left_semi")


def drop_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is not in ``keys.__drop``. A merge, as in ``keep_rows``."""
    return docs.join(keys.hint("merge"), _same(docs, keys["__drop"]), "left_anti")


def _same(docs: DataFrame, key: Column) -> Column:
    own = row_key(docs)
    return own.getField("i").eqNullSafe(key.getField("i")) & (own.getField("h") == key.getField("h"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): rows ``(node, root)`` with the smallest
    node reachable, for every node of an edge.

    Alternating large-star and small-star steps. A star is a group minimum
    (pre-aggregated per task) joined back to the edges, so a node with very many
    neighbours is never gathered in one task. Each round is written to the shared
    folder; only two counts reach the driver.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        """e: (u, v) pairs, u > v. Links what u reaches to the least of u and its neighbours."""
        both = e if not large else e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("__m")) \
            .select(F.col("u").alias("__u"), F.least("u", "__m").alias("__m"))
        joined = both.join(least, F.col("u") == F.col("__u"))
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("__m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("__m").alias("v")) \
                .union(least.select(F.col("__u").alias("u"), F.col("__m").alias("v")))
        return out.filter("u <> v").distinct()

    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = written(pairs, "edges")
    seen = None
    for _ in range(max_rounds):
        pairs = written(star(star(pairs, True), False), "stars")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def slices(rows: pa.RecordBatch | pa.Array, text: pa.Array, size: int) -> Iterator[tuple[pa.RecordBatch | pa.Array, list[str]]]:
    """Consecutive parts of ``rows`` with their texts, of about ``size`` bytes of text each (a longer text is a
    part of its own). Only one part's texts are Python objects at a time."""
    if not len(text):
        return
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(text):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield rows.slice(begin, end - begin), text.slice(begin, end - begin).to_pylist()
        begin = end
