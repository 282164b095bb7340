"""Sliding windows and session gaps as Structured Streaming.  The batch data model has no streams; watermarks are our own choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(stream: DataFrame, key: str, ts: str, length: str = "15 seconds", stride: str = "7500 milliseconds", late: str = "1 minute") -> DataFrame:
    """Events and mean value per key and sliding window, late events kept until the watermark passes."""
    return stream.withWatermark(ts, late).groupBy(key, F.window(ts, length, stride).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean")


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event runs per key that end after a gap."""
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
