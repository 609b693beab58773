"""Operator 2: mixing sources to target weights by Poisson replication. DataFrame functions only.

The mean repetition rate of a source is its share of the target size over its own size. A document's uniform number
comes from a hash of seed and id, so the draw does not depend on partitioning or retries; the Poisson distribution of
the source's rate is inverted at that number, the document is exploded by the count, and copies are dealt to
partitions and ordered by another hash: a global shuffle that can be repeated exactly.

The distribution belongs to the source, so it is summed up once for each source, within 12 deviations of its mean, and
a document finds its count there by bisection.

Sizes are characters plus one for each document (its end id), so no source that occurs has size 0.
Nulls: a null source is a source of its own; a null text has size 1. A row whose id is null, or occurs more than once,
draws by itself: its number comes from id, all columns and, of rows equal in all, a number from 0. Such rows are counted
before they travel and dealt out again in pieces, so one id or text may be that of most rows. Empty table: empty
result. Very long texts and ties need no care: a row travels whole, and keys are unique. Columns of the input named
mix_rate, mix_copy or mix_key are replaced; columns of map type cannot be compared and must be absent where ids repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import materialize, partitions, stored_bytes

#: A table of distributions, or of repeated ids, of so many bytes is broadcast; beyond, documents are salted.
BROADCAST_BYTES = 16_000_000
SALTS = 32
#: Equal rows that are dealt out together.
PIECE = 1024


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def uniform(text: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**13))


def distributions(rates: DataFrame) -> DataFrame:
    """rates (source_key, rate) with low, cdf (probabilities of low, low + 1, ... or less) and steps (for bisection);
    without the last three where the rate is 0. Beyond 12 deviations and 30 from the mean, the probability left is
    below what 52 bits can tell. Terms are sums of logarithms, so none underflows."""
    wide = 12 * F.sqrt("rate") + 30
    rows = rates.where("rate > 0").withColumn("low", F.greatest(F.lit(0), F.floor(F.col("rate") - wide)).cast("long"))
    rows = rows.withColumn("k", F.explode(F.sequence("low", F.ceil(F.col("rate") + wide).cast("long"))))
    low, r = F.col("low").cast("double"), F.col("rate")
    # Stirling's series for the first term; where it starts from 0, that is exp(-rate).
    series = low * F.log(r / low) - r + low - F.log(2 * F.lit(3.141592653589793) * low) / 2 - 1 / (12 * low) + 1 / (360 * low**3)
    first = F.when(F.col("low") == 0, -r).otherwise(series)
    term = F.when(F.col("k") == F.col("low"), first).otherwise(F.log(r) - F.log(F.col("k").cast("double")))
    up = Window.partitionBy("source_key").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("l", F.sum(term).over(up)).withColumn("c", F.sum(F.exp("l")).over(up))
    tables = rows.groupBy("source_key").agg(F.first("low").alias("low"), F.array_sort(F.collect_list("c")).alias("cdf"))
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.size("cdf") + 1))).cast("int")
    steps = F.transform(F.sequence(bits - 1, F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2.0), b).cast("int"))
    return rates.join(tables.withColumn("steps", steps), "source_key", "left")


def poisson_inverse(u: Column, low: Column, cdf: Column, steps: Column) -> Column:
    """How many k have a cumulative probability below u."""
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cdf, at + step - 1) < u, at + step).otherwise(at))
    return F.coalesce(low + found, F.lit(0).cast("long")).cast("int")


def source_sizes(df: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source_key, size; partial sums are made before the shuffle."""
    return df.groupBy(_key(F.col(source_col)).alias("source_key")).agg(F.sum(F.length(F.coalesce(F.col(text_col), F.lit(""))) + 1).alias("size"))


def repetition_rates(sizes: DataFrame, weights: dict | None = None, alpha: float = 0.5, total: float | None = None) -> DataFrame:
    """source_key, rate. Weights by source (None for null), in any scale; sources without one get 0. Without weights,
    a source's weight is its size to the power alpha. total: target size of the whole, by default as large as the input."""
    if weights is None:
        w = sizes.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        spark = sizes.sparkSession
        given = spark.createDataFrame([("null" if k is None else f"s:{k}", float(v)) for k, v in weights.items()], "source_key string, w double")
        w = sizes.join(given, "source_key", "left").fillna(0.0, ["w"])
    sums = w.agg(F.sum("size").cast("double").alias("size"), F.sum("w").alias("w")).first()  # two numbers
    goal = F.lit(sums["size"] if total is None else float(total))
    return w.select("source_key", F.coalesce(F.try_divide("w", F.lit(sums["w"])) * goal / F.col("size"), F.lit(0.0)).alias("rate"))


def mix_sources(
    df: DataFrame, weights: dict | None = None, alpha: float = 0.5, total: float | None = None, seed: int = 1,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The rows of df, each as often as drawn, in shuffled order, with mix_rate, mix_copy (from 0) and mix_key."""
    spark = df.sparkSession
    df = df.drop("mix_rate", "mix_copy", "mix_key")
    rates = materialize(distributions(repetition_rates(source_sizes(df, source_col, text_col), weights, alpha, total)), "rates")
    rows = _named(df, id_col, source_col, seed)
    rows = _looked_up(rows, rates, "source_key", F.sum(F.lit(100) + 8 * F.coalesce(F.size("cdf"), F.lit(0))))
    rows = rows.withColumn("n", poisson_inverse(uniform(F.col("name")), F.col("low"), F.col("cdf"), F.col("steps"))).where("n > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    key = F.md5(F.concat(F.col("name"), F.lit(":"), F.col("copy").cast("string")).cast("binary"))
    rows = rows.select("row.*", F.col("rate").alias("mix_rate"), F.col("copy").alias("mix_copy"), key.alias("mix_key"))
    return rows.repartition(partitions(spark, stored_bytes(df)), "mix_key").sortWithinPartitions("mix_key")


def _looked_up(rows: DataFrame, small: DataFrame, key: str, size: Column, how: str = "inner") -> DataFrame:
    """rows with the columns of a table of unique keys: broadcast up to a size, else met by key and salt."""
    if (small.agg(size.alias("n")).first()["n"] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), key, how)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))  # any will do
    return rows.join(salted, [key, "salt"], how).drop("salt")


def _named(df: DataFrame, id_col: str, source_col: str, seed: int) -> DataFrame:
    """row, source_key, name: the name that a row draws by, another one for each row."""
    # The row travels as a struct, so that no column of the input can clash with those made here.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _key(F.col(f"`{source_col}`")).alias("source_key"), F.col(f"`{id_col}`").cast("string").alias("id"))
    plain = F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit("")))
    again = materialize(df.groupBy(F.col(f"`{id_col}`").cast("string").alias("id")).count().where("id is null or count > 1").select("id", F.lit(True).alias("again")), "again")
    if again.isEmpty():
        return rows.select("row", "source_key", plain.alias("name"))
    rows = _looked_up(rows.withColumn("name", plain), again.where("id is not null"), "id", F.sum(F.length("id") + 40), "left")
    own = F.col("id").isNotNull() & F.col("again").isNull()
    equal = rows.where(~own).groupBy("row", "source_key", "name").agg(F.count("*").alias("many"))
    pieces = equal.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / PIECE))))
    pieces = pieces.repartition(partitions(df.sparkSession, stored_bytes(df)), F.xxhash64("row"), "piece")
    number = F.explode(F.sequence(F.col("piece") * PIECE, F.least(F.col("many"), (F.col("piece") + 1) * PIECE) - 1))
    numbered = pieces.select("row", "source_key", "name", number.alias("number"))
    name = F.concat("name", F.lit(":"), F.hex(F.xxhash64("row")), F.lit(":"), F.col("number").cast("string"))
    return rows.where(own).select("row", "source_key", "name").unionByName(numbered.select("row", "source_key", name.alias("name")))
