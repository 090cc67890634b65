"""Windowed counts over event streams. The same function serves batch frames, where the watermark has no effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, pattern: str = "*.parquet", files_a_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling or sliding windows of event time; later events than the watermark are
    dropped, so the state is bounded."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", lateness).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
