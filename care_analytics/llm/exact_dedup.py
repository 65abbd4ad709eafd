"""Exact dedup over an extendible-hash index on shared files (DataFrame operations only).

Method. The key of a text is its 64-bit hash. One aggregation on (key, text)
compares the bytes and, pre-aggregated in every map task, leaves one *entry* per
distinct text, so a group that holds a third of all rows reaches a reducer as one row
per task. Entries are written to the shared folder. The directory starts at
depth 0 and doubles: every bucket with more than ``bucket_keys`` entries splits on
its next hash bit, down to a depth that grows with the number of entries (``depth_for``: about sixteen
slots a bucket, so that hashes have room to be uneven). Entries are then dealt by range of
(bucket, key) to owner tasks, which chain entries of equal key (different texts that
collide) and write the index, sorted by key. Every document is then routed by the
directory to its bucket and finds its entry there by key and, inside a chain, by the SHA-256 of its bytes.

``add_documents`` takes further documents into an index: their entries are merged with those that it holds, overfull buckets
split and the directory doubles as far as it must. The texts that an index was built from are not kept, so against those
new texts are compared by key and SHA-256.

Defined cases: a null text counts as empty, and all such rows are one group; a
null id never stays before a non-null one; rows repeated with the same id and text are
one group and all are marked ``kept`` when their id is the one that stays
(``distinct_rows`` leaves one of them); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from care_analytics.llm.common import scratch_path, text_or_empty, written

BUCKET_KEYS = 4096        # entries a bucket holds before it splits
SLOTS_A_BUCKET = 16       # slots of the full directory for each bucket that entries would fill evenly
BROADCAST_DEPTH = 16      # a directory of at most 65,536 slots is broadcast; beyond, it is joined
DEEPEST = 30


@dataclass(frozen=True)
class Index:
    """``rows(__bucket, __depth, __key, __chain, __sha, __keep, __n)``, an entry for each distinct text, and the directory
    ``slots(__c, __bucket, __depth)`` over the first ``depth`` bits of a key."""

    rows: DataFrame
    slots: DataFrame
    depth: int
    bucket_keys: int


def depth_for(entries: int, bucket_keys: int) -> int:
    """Bits of the full directory for so many entries."""
    depth = 0
    while depth < DEEPEST and bucket_keys << depth < SLOTS_A_BUCKET * entries:
        depth += 1
    return depth


def directory(cells: DataFrame, max_depth: int, bucket_keys: int) -> DataFrame:
    """``cells(__cell, __n)``, the entries per ``max_depth``-bit prefix, -> (__c, __bucket, __depth).

    A bucket of depth d is a d-bit prefix; it splits when it holds more than
    ``bucket_keys`` entries, so the local depth of a cell is one more than the
    depth of its longest overfull prefix. At most 2^max_depth rows.
    """
    if not max_depth:
        return cells.select(F.col("__cell").alias("__c"), F.lit(0).alias("__depth"), F.lit(0).alias("__bucket"))
    grown = cells.withColumn("__d", F.explode(F.sequence(F.lit(0), F.lit(max_depth - 1)))) \
        .withColumn("__prefix", F.expr(f"shiftright(__cell, {max_depth} - __d)"))
    overfull = grown.groupBy("__d", "__prefix").agg(F.sum("__n").alias("__total")).filter(F.col("__total") > bucket_keys)
    splits = grown.join(overfull.select(F.col("__d").alias("__od"), F.col("__prefix").alias("__op")),
                        (F.col("__d") == F.col("__od")) & (F.col("__prefix") == F.col("__op")), "left") \
        .groupBy(F.col("__cell").alias("__c")).agg(F.coalesce(F.max("__od") + 1, F.lit(0)).alias("__depth"))
    return splits.withColumn("__bucket", F.expr(
        f"shiftleft(shiftright(__c, {max_depth} - __depth), {max_depth} - __depth)"))


def cell_of(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def _route(df: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """``df(__key, ...)`` with the bucket and its depth that the directory gives for each key."""
    small = F.broadcast(slots) if depth <= BROADCAST_DEPTH else slots          # at most 2^depth rows
    return df.withColumn("__cell", cell_of(F.col("__key"), depth)).join(small, F.col("__cell") == F.col("__c")).drop("__cell", "__c")


def _entries(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("__key", "__text").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__n")) \
        .select("__key", F.unhex(F.sha2("__text", 256)).alias("__sha"), "__keep", "__n")


def _index_of(entries: DataFrame, depth: int, bucket_keys: int) -> Index:
    """The index of ``entries(__key, __sha, __keep, __n)``, a stored table."""
    cells = entries.groupBy(cell_of(F.col("__key"), depth).alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    slots = written(directory(cells, depth, bucket_keys), "exact-directory")
    chain = F.row_number().over(Window.partitionBy("__bucket", "__key").orderBy("__keep", "__sha"))
    path = scratch_path(entries.sparkSession, "exact-index")
    (_route(entries, slots, depth).withColumn("__chain", chain)
     .select("__bucket", "__depth", "__key", "__chain", "__sha", "__keep", "__n")
     .repartitionByRange("__bucket", "__key").sortWithinPartitions("__bucket", "__key", "__chain")
     .write.parquet(path))
    return Index(entries.sparkSession.read.parquet(path), slots, depth, bucket_keys)


def open_index(keyed: DataFrame, max_depth: int | None = None, bucket_keys: int = BUCKET_KEYS) -> Index:
    """The index of ``keyed(__id, __key, __text)``. A stated ``max_depth`` bounds the directory; buckets that are still overfull
    there stay so."""
    entries = written(_entries(keyed), "exact-entries")
    return _index_of(entries, depth_for(entries.count(), bucket_keys) if max_depth is None else max_depth, bucket_keys)


def build_index(keyed: DataFrame, max_depth: int | None = None, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The rows of ``open_index``."""
    return open_index(keyed, max_depth, bucket_keys).rows


def add_documents(index: Index, keyed: DataFrame) -> Index:
    """The index with further documents ``keyed(__id, __key, __text)``; of equal texts the largest id stays, old or new. It is
    written anew from entries; no text is read again."""
    both = index.rows.select("__key", "__sha", "__keep", "__n").unionByName(_entries(keyed))
    entries = written(both.groupBy("__key", "__sha").agg(F.max("__keep").alias("__keep"), F.sum("__n").alias("__n")), "exact-entries")
    return _index_of(entries, max(index.depth, depth_for(entries.count(), index.bucket_keys)), index.bucket_keys)


def locate(keyed: DataFrame, index: Index) -> DataFrame:
    """``keyed(__id, __key, __text)`` -> (__id, __sha, __keep, __n) of the documents whose text the index holds: each is routed to
    its bucket and compared there."""
    probe = keyed.select("__id", "__key", F.unhex(F.sha2("__text", 256)).alias("__sha"))
    own = index.rows.select(F.col("__bucket").alias("__ibucket"), F.col("__key").alias("__ikey"), F.col("__sha").alias("__isha"),
                            "__keep", "__n")
    return _route(probe, index.slots, index.depth) \
        .join(own, (F.col("__bucket") == F.col("__ibucket")) & (F.col("__key") == F.col("__ikey")) & (F.col("__sha") == F.col("__isha"))) \
        .select("__id", "__sha", "__keep", "__n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_depth: int | None = None, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256). The row with the
    largest id of each group of equal texts stays."""
    base = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text")) \
        .withColumn("__key", F.xxhash64("__text"))
    return locate(base, open_index(base, max_depth, bucket_keys)) \
        .select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"),
                F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
                F.lower(F.hex("__sha")).alias("text_sha256"))


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were. Rows repeated with the
    same id and text leave one (only such rows are compared again)."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept") \
        .groupBy(F.col(id_col).alias("__keep"), F.col("text_sha256").alias("__sha")).agg(F.count(F.lit(1)).alias("__copies"))
    joined = docs.join(kept, docs[id_col].eqNullSafe(kept["__keep"])
                       & (F.sha2(text_or_empty(docs[text_col]), 256) == kept["__sha"]))
    once = joined.filter("__copies = 1").select(*[docs[c] for c in docs.columns])
    more = joined.filter("__copies > 1").withColumn("__row", F.row_number().over(
        Window.partitionBy("__keep", "__sha").orderBy(F.lit(0)))).filter("__row = 1").select(*[docs[c] for c in docs.columns])
    return once.union(more)
