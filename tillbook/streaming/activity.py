"""Sessions from a stream of user events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Fixed value: a session ends after one hour without an event.
IDLE = "1 hour"


def sessions(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Sessions per user: an event more than an hour after the last one starts a
    new session, one exactly an hour later still belongs.

    Works on a batch or a stream. A stream emits a session once the watermark
    has passed its end and drops events later than the watermark.
    """
    return (
        events.withWatermark("ts", watermark)
        .groupBy("user_id", F.session_window("ts", IDLE))
        .agg(
            F.min("ts").alias("login_time"),
            F.max("ts").alias("last_activity"),
            F.count(F.lit(1)).alias("events"),
        )
        .select(F.col("user_id").alias("customer_id"), "login_time", "last_activity", "events")
    )


def start(events: DataFrame, folder: str, watermark: str = "1 hour") -> StreamingQuery:
    """Write finished sessions to ``folder``/sessions, consuming what the stream holds now."""
    return (
        sessions(events, watermark)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/sessions")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )


def all_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Finished and open sessions after the last run of :func:`start`, told apart by
    ``is_active``; together they equal :func:`sessions` of all events taken in.

    To be read between runs: one that broke off is completed by the next.
    """
    finished = spark.read.parquet(f"{folder}/sessions").withColumn("is_active", F.lit(0))
    return finished.unionByName(open_sessions(spark, folder).withColumn("is_active", F.lit(1)))


def open_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that may still go on, straight from the state of the last batch: their
    number depends on the watermark, not on how many events have passed."""
    state = spark.read.format("statestore").load(f"{folder}/progress")
    return state.select(
        F.col("value.user_id").alias("customer_id"),
        F.col("value.min").alias("login_time"),
        F.col("value.max").alias("last_activity"),
        F.col("value.count").alias("events"),
    )
