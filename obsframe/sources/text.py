"""Text files of numbers.

Line numbers come from the place of each file block and the order of lines within it, so a large file is read by many
tasks; only one number for each block is accumulated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?|nan)))"
WHOLE = r"^\s*([+-]?\d+)"


def parse_number(text: Column, kind: str = "double") -> Column:
    """The number that a text begins with; 0 if there is none."""
    pattern = WHOLE if kind in ("int", "bigint", "long") else NUMBER
    kind = "bigint" if kind == "long" else kind
    return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast(kind), F.lit(0).cast(kind))


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None, skip: int = 0) -> DataFrame:
    """line (from 0), value, of lines from `skip` on that `keep` holds for; lines are numbered among those kept."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    lines = lines.withColumn("id", F.monotonically_increasing_id())
    block = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    if skip:
        counts = lines.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("id").alias("low"))
        counts = counts.select("f", "b", "low", F.coalesce(F.sum("n").over(block), F.lit(0)).alias("before"))  # a row per block
        lines = lines.join(F.broadcast(counts), ["f", "b"]).where(F.col("before") + F.col("id") - F.col("low") >= skip).drop("low", "before")
    if keep is not None:
        lines = lines.where(keep)
    counts = lines.groupBy("f", "b").agg(F.count("*").alias("n"))
    counts = counts.select("f", "b", F.coalesce(F.sum("n").over(block), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("f", "b").orderBy("id")) - 1
    return lines.join(F.broadcast(counts), ["f", "b"]).select((F.col("before") + inside).alias("line"), "value")


def read_matrix(spark: SparkSession, path: str, skip: int = 0, kind: str = "double") -> DataFrame:
    """i, j, v. Skips the first lines, blank lines and those that begin with #. Cells are separated by spaces; the first
    row fixes the number of columns: more cells are dropped, missing ones are 0, and so is what is not a number."""
    rows = numbered_lines(spark, path, (F.length("value") > 0) & ~F.col("value").startswith("#"), skip)
    rows = rows.select(F.col("line").cast("int").alias("i"), F.filter(F.split("value", " +"), lambda x: x != "").alias("cells"))
    head = rows.where("i = 0").select(F.size("cells").alias("n")).first()
    columns = head["n"] if head else 0
    cells = F.transform(F.sequence(F.lit(0), F.lit(max(columns - 1, 0))), lambda j: F.coalesce(parse_number(F.get("cells", j), kind), F.lit(0).cast(kind if kind != "long" else "bigint")))
    return rows.where(F.lit(columns > 0)).select("i", F.posexplode(cells).alias("j", "v"))


def _write(lines: DataFrame, path: str, append: bool, *order: str) -> None:
    lines.orderBy(*order).select("value").write.mode("append" if append else "errorifexists").text(path)


def _row_text(cells: Column) -> Column:
    """Each cell is followed by a space."""
    return F.array_join(F.transform(cells, lambda x: F.concat(x.cast("string"), F.lit(" "))), "")


def write_matrix(m: DataFrame, path: str, append: bool = False) -> None:
    """A line a row; absent cells are 0. No lines for an empty matrix."""
    columns = m.agg(F.max("j")).first()[0]
    rows = m.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("row"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(columns or 0)), lambda j: F.coalesce(F.try_element_at("row", j.cast(m.schema["j"].dataType)), F.lit(0).cast(m.schema["v"].dataType)))
    _write(rows.select("i", _row_text(cells).alias("value")), path, append, "i")


def write_vector(v: DataFrame, path: str, with_index: bool = False, append: bool = False) -> None:
    text = F.concat(F.col("i").cast("string"), F.lit(" "), F.col("v").cast("string")) if with_index else F.col("v").cast("string")
    _write(v.select("i", text.alias("value")), path, append, "i")


def tensor_lines(t: DataFrame, index: list[str], value: str = "v") -> DataFrame:
    """A line a cell: its indices and, after three spaces, the value. A scalar has the index 0."""
    if not index:
        return t.select(F.concat(F.lit("0 "), F.col(value).cast("string")).alias("value"))
    return t.select(*index, F.concat(F.concat_ws(" ", *[F.col(c).cast("string") for c in index]), F.lit("   "), F.col(value).cast("string")).alias("value"))


def write_tensor(t: DataFrame, path: str, index: list[str], append: bool = False) -> None:
    _write(tensor_lines(t, index), path, append, *(index or ["value"]))


def write(data: DataFrame, path: str, with_index: bool = False, append: bool = False) -> None:
    """A matrix, or a vector (no column j)."""
    if "j" in data.columns:
        write_matrix(data, path, append)
    else:
        write_vector(data, path, with_index, append)


def read_tensor(spark: SparkSession, path: str, index: list[str]) -> DataFrame:
    cells = F.split(F.trim("value"), " +")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(*[parse_number(F.get(cells, F.lit(k)), "int").alias(c) for k, c in enumerate(index)], parse_number(F.get(cells, F.lit(len(index)))).alias("v"))


def export_cube(cells: DataFrame, path: str, steps: int, observables: int, sizes: list[int]) -> None:
    """A comment, the sizes, a blank line, and `sum squares count` of every cell in row-major order; absent cells are 0.
    cells: step, observable and idx (row-major within a value) from 0."""
    spark, size = cells.sparkSession, 1
    for n in sizes:
        size *= n
    n = F.col("id")
    every = spark.range(steps * observables * size).select(n.alias("place"), F.floor(n / (observables * size)).cast("int").alias("step"), (F.floor(n / size) % observables).cast("int").alias("observable"), (n % size).cast("int").alias("idx"))
    body = every.join(cells, ["step", "observable", "idx"], "left").select("place", F.concat_ws(" ", *[F.coalesce(c, F.lit(0.0)).cast("string") for c in ("s", "q", "c")]).alias("value"))
    head = spark.createDataFrame([(-3, "#format 0: steps observables dimensions  sizes"), (-2, " ".join(map(str, [steps, observables, len(sizes), *sizes]))), (-1, "")], "place long, value string")
    _write(head.unionByName(body), path, False, "place")


def import_cube(spark: SparkSession, path: str) -> DataFrame:
    """step, observable, idx, s, q, c of an exported file. Raises if the file holds fewer cells than its sizes say."""
    lines = numbered_lines(spark, path, (F.length("value") > 0) & ~F.col("value").startswith("#"))
    head = [int(x) for x in lines.where("line = 0").first()["value"].split()]
    steps, observables, size = head[0], head[1], 1
    for n in head[3 : 3 + head[2]]:
        size *= n
    if lines.count() - 1 < steps * observables * size:
        raise ValueError(f"{path} holds fewer cells than {steps} x {observables} x {size}")
    n, parts = F.col("line") - 1, F.split(F.trim("value"), " +")
    return lines.where(f"line between 1 and {steps * observables * size}").select(
        F.floor(n / (observables * size)).cast("int").alias("step"), (F.floor(n / size) % observables).cast("int").alias("observable"), (n % size).cast("int").alias("idx"),
        *[parse_number(F.get(parts, F.lit(k))).alias(c) for k, c in enumerate("sqc")],
    )
