"""Streaming forms of the folds: the same functions run on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their value by type in fixed windows; late ones count up to the watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    t = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    return t.select(F.col("window.start").alias("from_ts"), "event_type", "n", "cents")


def session_counts(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Sessions of a user that end after ``gap`` without an event."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    t = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return t.select("user_id", F.col("session_window.start").alias("from_ts"), "n")


def once(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event id once."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over parquet files of events."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
