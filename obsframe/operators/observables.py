"""Measurements as a cube of moments: (step, observable, idx, s, q, c) with sum, sum of squares and count.

The triple is a mergeable partial aggregate, so every operator is a group-by with partial sums; totals are joined back
by observable and index, which Spark broadcasts when they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ["observable", "idx"]


def cube(df: DataFrame, step: Column, observable: Column, value: Column, idx: Column | None = None) -> DataFrame:
    v = value.cast("double")
    rows = df.select(step.alias("step"), observable.alias("observable"), (F.lit(0) if idx is None else idx).alias("idx"), v.alias("v")).where("v is not null")
    return rows.groupBy("step", *CELL).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").cast("double").alias("c"))


def empty_cube(spark: SparkSession, steps: int, observables: int, size: int) -> DataFrame:
    """All cells, zero: cell numbers are decoded, nothing is joined."""
    n = F.col("id")
    return spark.range(steps * observables * size).select(
        F.floor(n / (observables * size)).cast("int").alias("step"), (F.floor(n / size) % observables).cast("int").alias("observable"), (n % size).cast("int").alias("idx"),
        F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("c"),
    )


def merge(*cubes: DataFrame) -> DataFrame:
    out = cubes[0]
    for c in cubes[1:]:
        out = out.unionByName(c)
    return out.groupBy("step", *CELL).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("c").alias("c"))


def summary(cells: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """mean (ratio of sums) and sd (sample deviation rebuilt from moments; null for a single value), over all steps or
    an inclusive interval of them."""
    if low is not None:
        cells = cells.where((F.col("step") >= low) & (F.col("step") <= high))
    sums = cells.groupBy(*CELL).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("c").alias("c"), F.count("*").alias("steps"))
    mu = F.try_divide("s", "c")
    spread = F.col("q") - 2 * F.col("s") * mu + mu * mu * F.col("c")
    return sums.select(*CELL, mu.alias("mean"), F.when(F.col("c") > 1, F.sqrt(F.greatest(spread / (F.col("c") - 1), F.lit(0.0)))).alias("sd"), "steps")


def jackknife_means(cells: DataFrame) -> DataFrame:
    """step, theta: the mean without that step; mean, n: mean and number of all steps."""
    totals = cells.groupBy(*CELL).agg(F.sum("s").alias("all_s"), F.sum("c").alias("all_c"), F.count("*").alias("n"))
    theta = F.try_divide(F.col("all_s") - F.col("s"), F.col("all_c") - F.col("c"))
    return cells.join(totals, CELL).select("step", *CELL, theta.alias("theta"), F.try_divide("all_s", "all_c").alias("mean"), "n")


def jackknife_error(cells: DataFrame) -> DataFrame:
    d = F.col("theta") - F.col("mean")
    sums = jackknife_means(cells).groupBy(*CELL).agg(F.sum(d * d).alias("d"), F.max("n").alias("n"))
    return sums.select(*CELL, F.sqrt((F.col("n") - 1) / F.col("n") * F.col("d")).alias("jackknife"))


def report(cells: DataFrame) -> DataFrame:
    """mean, sd, steps and jackknife error together. Totals and steps both carry all three moments, so that the two uses
    of the cube share one exchange and its source is read once."""
    totals = cells.groupBy(*CELL).agg(F.sum("s").alias("all_s"), F.sum("q").alias("all_q"), F.sum("c").alias("all_c"), F.count("*").alias("n"))
    mu = F.try_divide("all_s", "all_c")
    d = F.try_divide(F.col("all_s") - F.col("s"), F.col("all_c") - F.col("c")) - mu
    kept = [F.max(x).alias(x) for x in ("all_s", "all_q", "all_c", "n")]
    sums = cells.join(totals, CELL).groupBy(*CELL).agg(F.sum(d * d).alias("d"), F.sum("q").alias("q"), *kept)
    spread = (F.col("q") + F.col("all_q")) / 2 - F.col("all_s") * mu  # the two sums of squares are one
    sd = F.when(F.col("all_c") > 1, F.sqrt(F.greatest(spread / (F.col("all_c") - 1), F.lit(0.0))))
    return sums.select(*CELL, mu.alias("mean"), sd.alias("sd"), F.col("n").alias("steps"), F.sqrt((F.col("n") - 1) / F.col("n") * F.col("d")).alias("jackknife"))


def binning(cells: DataFrame, bins: int = 10, steps: int | None = None) -> DataFrame:
    """Steps 0 to N-1 into bins; a bin counts as one value, the ratio of its sums. No change for N <= bins. N: given, or
    the largest step and one."""
    if steps is None:
        steps = (cells.agg(F.max("step")).first()[0] or 0) + 1
    if steps <= bins:
        return cells
    b = F.expr(f"((step + 1) * {bins} - 1) div {steps}").cast("int")
    sums = cells.withColumn("step", b).groupBy("step", *CELL).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    m = F.coalesce(F.try_divide("s", "c"), F.lit(0.0))
    return sums.select("step", *CELL, m.alias("s"), (m * m).alias("q"), F.when(F.col("c") > 0, 1.0).otherwise(0.0).alias("c"))


PRIME = 2**31 - 1


def drawn_step(sample: Column, draw: Column, steps: int) -> Column:
    """A step for each sample and draw: three quadratic rounds modulo a prime, exact in 64-bit integers."""
    h = (sample.cast("long") * 1_000_003 + draw.cast("long") * 10_007 + 17) % PRIME
    for c in (11, 23, 37):
        h = (h * h % PRIME + h * 48_271 + c) % PRIME
    return (h % steps).cast("int")


def bootstrap(cells: DataFrame, samples: int, draws: int, steps: int) -> DataFrame:
    """sample, draw and the cells of the drawn step. Sample 0 is the data themselves; others draw from all steps with
    replacement, by integer arithmetic that any engine can repeat."""
    n = F.col("id")
    plan = cells.sparkSession.range(samples * draws).select(F.floor(n / draws).cast("int").alias("sample"), (n % draws).cast("int").alias("draw"))
    step = F.when(F.col("sample") == 0, F.col("draw")).otherwise(drawn_step(F.col("sample"), F.col("draw"), steps))
    return plan.withColumn("step", step).join(cells, "step")


def sample_means(drawn: DataFrame) -> DataFrame:
    return drawn.groupBy("sample", *CELL).agg(F.try_divide(F.sum("s"), F.sum("c")).alias("theta"))


def sample_error(means: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """Deviation of samples, about their mean or a given one (observable, idx, mean)."""
    if about is None:
        return means.groupBy(*CELL).agg(F.stddev_samp("theta").alias("error"))
    d = F.col("theta") - F.col("mean")
    sums = means.join(about.select(*CELL, "mean"), CELL).groupBy(*CELL).agg(F.sum(d * d).alias("d"), F.count("*").alias("n"))
    return sums.select(*CELL, F.when(F.col("n") > 1, F.sqrt(F.col("d") / (F.col("n") - 1))).alias("error"))
