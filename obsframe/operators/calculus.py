"""Differences and quadrature: of series (keys..., i, v) with equal spacing, and of column expressions.

Neighbours are met by equi-joins on i, so one long series is spread over tasks; a window would sort it in one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _moved(df: DataFrame, keys: list[str], by: int, name: str) -> DataFrame:
    return df.select(*keys, (F.col("i") - by).alias("i"), F.col("v").alias(name))


def forward_difference(df: DataFrame, h: float, keys: list[str] | None = None) -> DataFrame:
    """d = (v_(i+1) - v_i) / h; null at the end."""
    keys = keys or []
    return df.join(_moved(df, keys, 1, "_next"), [*keys, "i"], "left").withColumn("d", (F.col("_next") - F.col("v")) / h).drop("_next")


def central_difference(df: DataFrame, h: float, keys: list[str] | None = None) -> DataFrame:
    """d = (v_(i+1) - v_(i-1)) / 2h; null at both ends."""
    keys = keys or []
    out = df.join(_moved(df, keys, 1, "_next"), [*keys, "i"], "left").join(_moved(df, keys, -1, "_last"), [*keys, "i"], "left")
    return out.withColumn("d", (F.col("_next") - F.col("_last")) / (2 * h)).drop("_next", "_last")


def derivative(f: Callable[[Column], Column], x: Column, h: float, points: int = 3) -> Column:
    """Two- or three-point derivative of a column expression."""
    return (f(x + h) - f(x)) / h if points == 2 else (f(x + h) - f(x - h)) / (2 * h)


def trapezium_weight(i: Column, n: Column | int) -> Column:
    return F.when((i == 0) | (i == n), 0.5).otherwise(1.0)


def simpson_weight(i: Column, n: Column | int) -> Column:
    """For an even n."""
    return F.when((i == 0) | (i == n), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) / 3


def integrate(spark: SparkSession, f: Callable[[Column], Column], low: float, high: float, n: int, rule: str = "trapezium") -> DataFrame:
    """integral of a column expression on n intervals (Simpson: n is made even); nodes are generated in the cluster."""
    n += n % 2 if rule == "simpson" else 0
    h = (high - low) / n
    i = F.col("id")
    w = simpson_weight(i, n) if rule == "simpson" else trapezium_weight(i, n)
    return spark.range(n + 1).agg((F.sum(w * f(F.lit(float(low)) + i * h)) * h).alias("integral"))


def integrate_series(df: DataFrame, h: float, n: int, rule: str = "trapezium", keys: list[str] | None = None) -> DataFrame:
    """integral of a series with indices 0 to n. Simpson's rule covers an even number of intervals; of an odd number, the
    last interval is a trapezium."""
    even = n - n % 2 if rule == "simpson" else 0
    i = F.col("i")
    simpson = F.when(i <= even, simpson_weight(i, even)).otherwise(0.0) if even else F.lit(0.0)
    rest = F.when(i >= even, trapezium_weight(i - even, n - even)).otherwise(0.0) if even < n else F.lit(0.0)
    return df.where(i.between(0, n)).groupBy(*(keys or [])).agg((F.sum((simpson + rest) * F.col("v")) * h).alias("integral"))
