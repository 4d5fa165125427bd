"""Streams of oriented events: windowed nematic order with a watermark; the moments are algebraic, so state is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axial import fold


def windowed_order(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """window start, groups, n, order, mean_angle of events (ts, theta); works on streams and on tables."""
    c, s = F.avg(F.cos(2.0 * F.col("theta"))), F.avg(F.sin(2.0 * F.col("theta")))
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), *by)
    out = out.agg(F.count("theta").alias("n"), F.sqrt(c * c + s * s).alias("order"), fold(0.5 * F.atan2(s, c)).alias("mean_angle"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "order", "mean_angle")
