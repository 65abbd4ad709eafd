"""The flat tables on storage: read with a schema check, write, publish results."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager
from functools import cache
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.flatten import FLATTENERS, flatten, flatten_split, is_wide
from ..schemas import CORRUPT, TABLE_OF
from .bundles import corrupt_documents, resources, shared
from .contracts import conform
from .merge import BATCH, ID, VERSION, current_rows, keyed, newest
from .snapshots import Snapshots


class Warehouse:
    """Parquet tables under one root folder. Tables that were written together are published together (``snapshots``). Streaming
    adds folders of batches to them, which ``compact`` folds in; of a resource that came more than once, readers see the
    newest version. A root without a manifest has one folder per table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.snapshots = Snapshots(spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{self.snapshots.current().get(name, name)}"

    def table(self, name: str, check: bool = True) -> DataFrame:
        """Read a table; with ``check``, hold it to its declared types at every depth."""
        df = self._stored(name)
        return conform(df, expected, f"table {name}") if check and (expected := expected_schema(self.spark, name)) else df

    def _stored(self, name: str, merged: bool = True) -> DataFrame:
        """The published table and the batches after it; with ``merged``, only the newest version of each resource."""
        tables, folded = self.snapshots.state()
        batches = [b for b in self.snapshots.folders(name, f"{BATCH}=") if int(b.split("=")[1]) > folded]
        parts = [self.spark.read.parquet(f"{self.root}/{tables[name]}")] if name in tables else []
        if batches:
            parts.append(self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/{b}" for b in batches]))
        if not parts:
            return self.spark.read.parquet(f"{self.root}/{name}")
        df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        if ID not in df.columns or not merged:
            return df
        return current_rows(df).drop(ID, VERSION)

    def compact(self, names: Iterable[str] | None = None, file_bytes: int = 128 << 20) -> int:
        """Folds all stream batches into the published tables (actions): the newest version of each resource, in files of about
        ``file_bytes``. Readers see the batches until the manifest names the new tables; the folders of batches that an earlier
        ``compact`` folded are removed. Returns the last batch folded."""
        names = list(names or [*TABLE_OF.values(), CORRUPT])
        _, before = self.snapshots.state()
        found = sorted({int(b.split("=")[1]) for n in names for b in self.snapshots.folders(n, f"{BATCH}=")})
        if not found or found[-1] <= before:
            return before
        version, tables = self.snapshots.new_version(), {}
        for name in names:
            if self.snapshots.folders(name, f"{BATCH}="):
                df = self._stored(name, merged=False)
                df = current_rows(df) if ID in df.columns else df
                rows = df.hint("rebalance").withColumn(BATCH, F.col(BATCH).cast("long"))
                _write_in_files(rows, f"{self.root}/{version}/{name}", file_bytes)
                tables[name] = f"{version}/{name}"
        self.snapshots.publish(tables, folded=found[-1])
        for name in names:
            for b in self.snapshots.folders(name, f"{BATCH}="):
                if int(b.split("=")[1]) <= before:
                    self.snapshots.remove(name, b)
        return found[-1]

    def write(self, df: DataFrame, name: str) -> None:
        """Write one table and make it current (an action); the other tables stay as they are."""
        version = self.snapshots.new_version()
        df.write.parquet(f"{self.root}/{version}/{name}")
        self.snapshots.publish({name: f"{version}/{name}"})

    def build(self, entries: DataFrame, types: Iterable[str] | None = None,
              grain: str = "line", stage: str = "parquet", merge: bool = False, staged: Callable[[], None] | None = None) -> list[str]:
        """Flatten and write every resource type, then publish them all at once (actions).

        ``stage="parquet"`` (default) writes the entries once, partitioned
        by resource type and by whether the product of a resource's arrays is wide, beside the tables; each table then reads
        only its own partitions, and wide products are spread over all tasks. The input is parsed once, no executor has
        to hold it in memory, and the twelve writes restart from the staged
        files, not from the raw bundles, if executors are lost. A type's part of the
        staged copy is removed when its table is written; ``staged`` is called when the copy holds all entries, so that input which is not
        wanted any more can go. Malformed documents go to
        the table ``_corrupt``; its row count says how many there were.
        ``stage="memory"`` persists the entries instead (small inputs).

        ``merge`` keeps the newest version of a resource that the bundles hold more than once; without it all are
        kept, as they come. Readers see the old tables until the last one is written. A build that fails leaves them so; its folder is
        removed by ``vacuum``.
        """
        types = list(types or TABLE_OF)
        if merge:
            entries = newest(keyed(entries))
        version = self.snapshots.new_version()
        if stage != "parquet":
            with shared(entries.withColumn("wide", wide_products(types))) as e:
                tables = self._tables(e, types, grain, version)
        else:
            path = f"{self.root}/{version}/_staging"
            copy = stage_entries(entries, types, path)
            if staged:
                staged()
            tables = self._tables(copy, types, grain, version, lambda rtype: _remove(self.spark, f"{path}/resource_type={rtype}"))
            _remove(self.spark, path)
        self.snapshots.publish(tables)
        return [TABLE_OF[rtype] for rtype in types]

    def _tables(self, entries: DataFrame, types: Iterable[str], grain: str, version: str, written: Callable[[str], None] = lambda _: None) -> dict[str, str]:
        def table(rtype: str) -> str:
            name = TABLE_OF.get(rtype, CORRUPT)
            rows = corrupt_documents(entries) if rtype == CORRUPT else flatten_split(
                entries.filter(F.col("resource_type") == rtype), FLATTENERS[rtype], grain=grain, wide=F.col("wide"))
            self._write_table(rows, f"{self.root}/{version}/{name}")
            written(rtype)
            return name
        return {name: f"{version}/{name}" for name in beside(self.spark, table, [*types, CORRUPT])}

    def _write_table(self, df: DataFrame, path: str) -> None:
        df.write.option("compression", COMPRESSION).parquet(path)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes what the last ``keep`` published sets do not use."""
        return self.snapshots.vacuum(keep)

    def row_counts(self, names: Iterable[str] | None = None) -> DataFrame:
        """One row per table, held to its declared types: (table_name, num_rows), from a single union job."""
        parts = [self.table(n).agg(F.count(F.lit(1)).alias("num_rows"))
                 .select(F.lit(n).alias("table_name"), "num_rows")
                 for n in (names or TABLE_OF.values())]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


COMPRESSION = "zstd"       # of tables and staged entries: three quarters of the default's bytes
# Input is read in splits that are small for their bytes: a split of compressed bundles is many times its size as text, and one file at least.
STAGING = {"spark.sql.variant.inferShreddingSchema": "false", "spark.sql.files.maxPartitionBytes": str(16 << 20)}
TABLES_AT_ONCE = 4         # a table's last tasks leave cores idle, which the next table uses


def beside(spark: SparkSession, write: Callable[[str], str], names: Iterable[str]) -> list[str]:
    """``write`` of each name, some beside each other, under the caller's job group; ends when all have, and raises what the first failing one did."""
    with ThreadPool(TABLES_AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(spark)(write), list(names), chunksize=1)


def stage_entries(entries: DataFrame, types: Iterable[str], path: str, keep: Iterable[str] = ()) -> DataFrame:
    """Entries of ``types`` and malformed documents written to ``path``, partitioned by type and by whether their product is wide, and
    read back (an action). ``keep`` are further columns. A task writes its partitions beside each other instead of sorting its entries by
    partition, and resources stay whole: to split each into a Parquet column for each of its fields takes longer than to parse it."""
    types, spark = list(types), entries.sparkSession
    rows = entries.withColumn("wide", wide_products(types)).filter(F.col("resource_type").isin(*types, CORRUPT)) \
        .select("resource", *keep, "resource_type", "wide")
    with set_conf(spark, {**STAGING, "spark.sql.maxConcurrentOutputFileWriters": str(2 * (len(types) + 1))}):
        rows.write.mode("overwrite").option("compression", COMPRESSION).option("parquet.compression.codec.zstd.level", 6) \
            .option("parquet.block.size", 16 << 20).partitionBy("resource_type", "wide").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def wide_products(types: Iterable[str]) -> Column:
    """Whether the product of an entry's arrays is to be spread over tasks, by its type."""
    wide = F.lit(False)
    for rtype in types:
        if len(FLATTENERS[rtype].arrays) > 1:
            wide = F.when(F.col("resource_type") == rtype, is_wide(F.col("resource"), FLATTENERS[rtype])).otherwise(wide)
    return wide


def _write_in_files(df: DataFrame, path: str, file_bytes: int) -> None:
    """Writes rows in as few files as ``file_bytes`` allows; adaptive execution merges small partitions and splits large ones."""
    with set_conf(df.sparkSession, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(file_bytes)}):
        df.write.option("compression", COMPRESSION).parquet(path)


@contextmanager
def set_conf(spark: SparkSession, settings: dict[str, str]):
    """Session settings for the length of a block."""
    old = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_result(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> str:
    """Publish an analysis result table as Parquet (an action)."""
    path = f"{root.rstrip('/')}/{name}"
    df.write.mode(mode).parquet(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def expected_schema(spark: SparkSession, name: str) -> StructType | None:
    """The declared schema of a warehouse table (no job); None for other tables."""
    return next((_declared(rtype) for rtype, table in TABLE_OF.items() if table == name), None)


@cache
def _declared(rtype: str) -> StructType:
    """The schema that a type is flattened to; the same in every session, and analysed once."""
    none = SparkSession.active().createDataFrame([], "resource_type string, resource string").select("resource_type", F.parse_json("resource").alias("resource"))
    return flatten(resources(none, rtype), FLATTENERS[rtype]).schema
