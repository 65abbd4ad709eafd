"""Incremental bundle ingestion with Structured Streaming.

New bundle files landing in a folder are flattened into the same twelve
warehouse tables as the batch ETL. Each micro-batch is written with
``foreachBatch`` into a folder named after its batch id, in overwrite mode:
if a batch is replayed after a failure (the checkpoint records progress
only after the batch commits), it rewrites the same folder, so every input
file lands exactly once. A batch is parsed once, into a staged copy that its tables read (``warehouse.stage_entries``). Rows carry their resource's id and version, so a bundle that comes again
replaces what it brought before; readers (``Warehouse.table``) see the newest version of each resource, with a
``batch_id`` column. Every ``compact_every`` batches the folders are folded into one set of tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.flatten import FLATTENERS, flatten_split
from ..schemas import BUNDLE, CORRUPT, TABLE_OF
from ..session import checkpoint_dir
from ..sources.bundles import bundle_entries, corrupt_documents
from ..sources.merge import ID, VERSION, keyed, newest_stored
from ..sources.snapshots import VERSIONS, Snapshots
from ..sources.warehouse import COMPRESSION, Warehouse, beside, stage_entries


def bundle_stream(spark: SparkSession, input_dir: str, ndjson: bool = True,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.schema(BUNDLE).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", not ndjson))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return bundle_entries(reader.json(input_dir), keep_corrupt=True)


def write_batch(output_root: str, types: Iterable[str], grain: str = "line", compact_every: int | None = None):
    """A ``foreachBatch`` function: flatten one micro-batch into every table (malformed documents into ``_corrupt``)."""
    types = list(types)

    def run(batch: DataFrame, batch_id: int) -> None:
        root = output_root.rstrip("/")
        staging = f"{VERSIONS}/batch-{batch_id}"            # a batch that runs again writes it anew; ``vacuum`` removes what a dead writer left
        with newest_stored(stage_entries(keyed(batch), types, f"{root}/{staging}", keep=(ID, VERSION))) as newest_of:
            def table(rtype: str) -> str:
                name = TABLE_OF.get(rtype, CORRUPT)
                own = newest_of(rtype)
                rows = corrupt_documents(own) if rtype == CORRUPT else \
                    flatten_split(own, FLATTENERS[rtype], grain=grain, keep=(ID, VERSION), wide=F.col("wide"))
                rows.write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{root}/{name}/batch_id={batch_id}")
                return name
            beside(batch.sparkSession, table, [*types, CORRUPT])
        Snapshots(batch.sparkSession, root).remove(staging)
        if compact_every and batch_id % compact_every == compact_every - 1:
            Warehouse(batch.sparkSession, output_root).compact([*(TABLE_OF[t] for t in types), CORRUPT])
    return run


def start(spark: SparkSession, input_dir: str, output_root: str, ndjson: bool = True,
          checkpoint: str | None = None, types: Iterable[str] | None = None,
          available_now: bool = True, processing_time: str | None = None,
          max_files_per_trigger: int | None = None, grain: str = "line", compact_every: int | None = 32) -> StreamingQuery:
    """Start ingestion. ``available_now`` processes what is there and stops;
    otherwise a micro-batch runs every ``processing_time``. Progress lives in
    ``checkpoint``; without it, in a folder of fixed name under the session's shared
    checkpoint folder, so a restarted driver goes on where the last one stopped. With
    neither, the call is an error."""
    key = hashlib.sha1(f"{input_dir}|{output_root}".encode()).hexdigest()[:12]
    ckpt = checkpoint or f"{checkpoint_dir(spark)}/stream-{key}"
    writer = (bundle_stream(spark, input_dir, ndjson, max_files_per_trigger).writeStream
              .foreachBatch(write_batch(output_root, types or TABLE_OF, grain, compact_every))
              .option("checkpointLocation", ckpt))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
