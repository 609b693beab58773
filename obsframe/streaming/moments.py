"""Sum, squares and count over event-time windows of a stream; late rows beyond the watermark are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_moments(df: DataFrame, time: str, observable: Column, value: Column, width: str, lateness: str | None = None) -> DataFrame:
    """start, observable, s, q, c: the cube's columns with a window's start for a step; a batch or a stream."""
    if df.isStreaming and lateness:
        df = df.withWatermark(time, lateness)
    v = value.cast("double")
    rows = df.select(F.col(time), observable.alias("observable"), v.alias("v")).where("v is not null")
    sums = rows.groupBy(F.window(time, width).alias("w"), "observable").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").cast("double").alias("c"))
    return sums.select(F.col("w.start").alias("start"), "observable", "s", "q", "c")
