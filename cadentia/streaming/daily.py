"""Structured Streaming over samples: an extension, the batch operators' counters kept up to date.

State is bounded by the watermark: windows close, and what they held is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zone_counters(samples: DataFrame, zone: Column, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Samples of a stream (user_id, ts, value, ...) by user, window and zone."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "user_id", zone.alias("zone")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("user_id", F.col("w.start").alias("start"), "zone", "n", "mean")


def daily_load(workouts: DataFrame, late: str = "1 day") -> DataFrame:
    """A day's stress and workouts by athlete from a stream of (athlete_id, ts, tss)."""
    return workouts.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "athlete_id").agg(F.sum(F.coalesce("tss", F.lit(0.0))).alias("tss"), F.count("*").alias("n")).select("athlete_id", F.to_date("w.start").alias("date"), "tss", "n")


def distinct_workouts(workouts: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream without repeats of the natural key inside the watermark."""
    return workouts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["athlete_id", "ts", "duration_seconds", "sport"])
