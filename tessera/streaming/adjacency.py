"""Daily adjacency from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_adjacency(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """``(day, src, dst, weight)`` of a stream of ``events (ts, user_id, event_type)``; a day is final once the
    watermark has passed it."""
    days = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), F.col("user_id").alias("src"), F.col("event_type").alias("dst"))
    return days.agg(F.count(F.lit(1)).cast("double").alias("weight")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "src", "dst", "weight")
