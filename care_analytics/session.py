"""Session settings the library relies on, and the shared checkpoint folder.

Library code never creates its own session; callers pass one. ``configure``
sets only what is unset, so a cluster's own settings always win.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution re-plans joins and partition counts from real sizes;
# skew handling splits oversized join partitions (one hot patient).
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession, overrides: dict[str, str] | None = None) -> SparkSession:
    conf = spark.conf
    for key, value in {**RECOMMENDED, **(overrides or {})}.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, as the session names it.

    There is no fallback: a folder on the driver's disk is not seen by executors, and a
    stream that starts in a new one loses its progress.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        raise ValueError("no checkpoint folder: set spark.checkpoint.dir to a folder that all executors "
                         "share, or call SparkContext.setCheckpointDir, before this step")
    return d


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "care_analytics",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benchmarks (UI off, no servers). Files are read in small
    splits, so that a small table still feeds every core."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.files.minPartitionNum", str(cores if cores != "*" else 8))
         .config("spark.sql.files.openCostInBytes", "65536")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g")
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in {**RECOMMENDED, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
