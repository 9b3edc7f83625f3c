"""Event streams in windows; the same functions take batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Streams with a watermark on ts, which has to be a timestamp with a zone; batches as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """(event_type, start, n, total) for each window; events later than `late` behind the newest are dropped from streams."""
    found = _timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("event_type", F.col("w.start").alias("start"), "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "1 hour") -> DataFrame:
    found = _timed(events, late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select("event_type", F.col("w.start").alias("start"), "n")
