"""The event log as a stream: subscription, delivery and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.session import schema

SCHEMA = schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def source(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as they arrive in a folder of Parquet files."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, *, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by type and window; events later than ``late`` are left out (extension)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def once(events: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Events with each id once within the watermark (extension)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def deliver(events: DataFrame, target: str, dead: str, checkpoint: str, accept: str) -> StreamingQuery:
    """Append accepted events to ``target`` and the rest to the dead-letter table, batch by batch.

    A batch writes under its own number, so a replayed batch overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            kept.where(accept).write.mode("overwrite").parquet(f"{target}/batch={number}")
            kept.where(f"not coalesce({accept}, false)").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            kept.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
