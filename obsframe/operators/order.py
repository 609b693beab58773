"""Positions and running sums over all rows without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

WIDTH = 1 << 16


def running_sum(df: DataFrame, index: str, value: str, keys: list[str] | None = None, name: str = "running", width: int = WIDTH) -> DataFrame:
    """df with the sum of value up to and including each index. Sums of ranges of `width` indices are accumulated first,
    then rows within a range, so a task sees a range and not the whole series."""
    keys = keys or []
    rows = df.withColumn("_range", F.floor(F.col(index) / width))
    sums = rows.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, [*keys, "_range"]).withColumn(name, F.col("_before") + F.sum(value).over(inside)).drop("_range", "_before")


def number_rows(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with each row's position (from 0) in the order: a range exchange, written once, and an offset for each of its
    partitions."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = checkpoint(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row per partition
    low = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + low).drop("_part", "_before", "_id")
