"""Incremental forms of two batch jobs: daily counts, and resuming over new files.

The engine's jobs are bounded; these show the same plans over a growing folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_counts(events: DataFrame) -> DataFrame:
    """(day, user_id, n, total) of a bounded table."""
    return events.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def daily_counts_stream(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The same counts over a stream: day windows, closed ``lateness`` after the newest event."""
    days = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), "user_id")
    return days.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("day"), "user_id", "n", "total")


def resume(spark: SparkSession, source: str, schema, transform, sink: str, checkpoint: str):
    """Process the files of ``source`` that no earlier run has seen, and stop."""
    rows = spark.readStream.schema(schema).parquet(source)
    return transform(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def distinct_stream(rows: DataFrame, event_time: str, keys: list[str], within: str = "1 day") -> DataFrame:
    """First row of each key within a watermark: the streaming form of content dedup."""
    return rows.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)
