"""Statistics of long tables. All are partial aggregates: rows are reduced before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import number_rows, running_sum


def class_of(x: Column, n: int, low: float, high: float) -> Column:
    """Class 0 to n-1 of [low, high], the last one closed; null outside."""
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - F.lit(float(low))) / F.lit(float(high - low)) * n).cast("int"), F.lit(n - 1)))


def histogram(df: DataFrame, value: str, n: int, low: float, high: float) -> DataFrame:
    """class, count of all n classes, empty ones included."""
    counts = df.select(class_of(F.col(value).cast("double"), n, low, high).alias("class")).where("class is not null").groupBy("class").count()
    classes = df.sparkSession.range(n).select(F.col("id").cast("int").alias("class"))
    return classes.join(counts, "class", "left").select("class", F.coalesce("count", F.lit(0)).alias("count"))


def class_members(df: DataFrame, index: str, value: str, n: int, low: float, high: float) -> DataFrame:
    """class, index of each member: a row a member, so a full class is no problem."""
    return df.select(class_of(F.col(value).cast("double"), n, low, high).alias("class"), index).where("class is not null")


def total(df: DataFrame, value: str, keys: list[str] | None = None, index: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Sum over rows, within an inclusive interval of an index."""
    if index is not None:
        df = df.where((F.col(index) >= low) & (F.col(index) <= high))
    return df.groupBy(*(keys or [])).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"))


def deviation(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.stddev_pop(value).alias("sd"))


def mean_product(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Uncentred."""
    return df.groupBy(*(keys or [])).agg(F.avg(F.col(a) * F.col(b)).alias("corr"))


def weighted_median(df: DataFrame, index: str, weight: str, keys: list[str] | None = None) -> DataFrame:
    """The last index at which the running sum of weights is no more than half their total; 0 at least."""
    keys = keys or []
    totals = df.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    rows = running_sum(df, index, weight, keys)
    if keys:
        rows = rows.join(totals, keys)
    else:
        rows = rows.withColumn("_total", F.lit(totals.first()["_total"]))
    return rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("running") <= F.col("_total") / 2, F.col(index))), F.lit(0)).alias("median"))


def extremes(df: DataFrame, index: list[str], value: str, keys: list[str] | None = None) -> DataFrame:
    """Maximum and minimum with the first index of each, in row-major order."""
    later = F.struct(F.col(value).alias("v"), *[(-F.col(c)).alias(c) for c in index])
    sooner = F.struct(F.col(value).alias("v"), *[F.col(c) for c in index])
    out = df.groupBy(*(keys or [])).agg(F.max(later).alias("a"), F.min(sooner).alias("b"))
    return out.select(*(keys or []), F.col("a.v").alias("maximum"), *[(-F.col(f"a.{c}")).alias(f"max_{c}") for c in index], F.col("b.v").alias("minimum"), *[F.col(f"b.{c}").alias(f"min_{c}") for c in index])


def argsort(df: DataFrame, index: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """rank (from 0) of each row by value, ties by index: within keys, or over all rows by a range exchange."""
    if keys:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(value, index)) - 1)
    return number_rows(df, value, index)
