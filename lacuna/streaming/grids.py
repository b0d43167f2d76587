"""Rasters that grow with a stream of events. The established batch operators have no streaming side; this is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(iy, ix, v) of each day and hour of a stream (ts), closed once the watermark has passed it.

    The state holds one row for each open hour; rows later than the watermark are dropped by it.
    """
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    hours = ts.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").cast("double").alias("v"))
    day = F.datediff(F.col("w.start"), F.lit("2024-01-01"))
    return hours.select(day.cast("long").alias("iy"), F.hour("w.start").cast("long").alias("ix"), "v")
