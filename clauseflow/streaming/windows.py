"""Windowed aggregates that serve a batch DataFrame and a stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def usage_windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Tumbling usage roll-up per event type; cents keep the sum exact."""
    return events.groupBy(F.window("ts", width).alias("window"), "event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"),
    )


def sliding_rate(events: DataFrame, width: str, slide: str, limit: int) -> DataFrame:
    """Sliding request count per user with a limit check."""
    w = events.groupBy("user_id", F.window("ts", width, slide).alias("window")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return w.withColumn("over_limit", F.col("n") > limit)
