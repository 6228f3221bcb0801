"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings, applied to any session handed to us.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where the next step then needs another shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Keys that hardly recur, such as an order's product, fill a hash table with all rows of
    # a partition, in many times the bytes they had in the shuffle; pairs multiply them again.
    # A quarter of Spark's size for partitions put together keeps a task's tables as much smaller.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # Parquet holds keys in a fraction of their size in memory; without this
    # factor a broadcast is chosen by the size of the file.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # Merge a user's events into sessions before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Partitions a shuffle starts with at least, before adaptive execution puts small ones together:
# it never cuts one that is large, so that with a few a task takes all that the input grows by.
# Up to Spark's 200 a map task writes them without sorting its rows in memory first.
PARTITIONS = 200
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def pin(spark: SparkSession) -> SparkSession:
    """Pin the time zone and adaptive execution (skew-join splitting, partition
    coalescing); partition counts and memory stay as the cluster set them."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """:func:`pin`, and shuffles that start with PARTITIONS partitions or as many as the
    cluster set, if those are more; memory stays as the cluster set it."""
    wanted = max(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(INITIAL, None) or 0))
    if spark.conf.get(INITIAL, None) != str(wanted):
        spark.conf.set(INITIAL, str(wanted))
    return pin(spark)


def local_session(cores: str = "8", name: str = "tillbook") -> SparkSession:
    """Session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        # Plans have many columns; recording a call site for each is slow.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return pin(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the one named in ``spark.checkpoint.dir``.

    Where a session names none, a folder in the warehouse, which executors share
    by definition. Everything of one application lies in one subfolder named by its
    id and may be deleted once the application has ended.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
    return f"{folder.rstrip('/')}/tillbook-{spark.sparkContext.applicationId}"
