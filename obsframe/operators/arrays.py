"""Indexing of tensors in the long form: one row a cell, with a column for each index. Nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def sub_array(m: DataFrame, index: str, i: int) -> DataFrame:
    """Fix one index and drop it."""
    return m.where(F.col(index) == i).drop(index)


def interval(m: DataFrame, index: str, low: int, high: int) -> DataFrame:
    """Cells with an index from low to high, both included, numbered from 0."""
    kind = m.schema[index].dataType
    return m.where(F.col(index).between(low, high)).withColumn(index, (F.col(index) - low).cast(kind))


def rotate(x: DataFrame, offset: int, n: int, index: str = "i") -> DataFrame:
    """Element m of the result is element (m + offset) mod n of a series of n."""
    return x.withColumn(index, F.pmod(F.col(index) - offset, F.lit(n)).cast(x.schema[index].dataType))


def shift(x: DataFrame, offset: int, index: str = "i") -> DataFrame:
    """A positive offset moves right (cells that are absent are zero); a negative one drops elements from the front."""
    moved = x.withColumn(index, (F.col(index) + offset).cast(x.schema[index].dataType))
    return moved.where(F.col(index) >= 0) if offset < 0 else moved


def blockify(m: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Each index named in sizes becomes a block index (its name after b) and an index within the block."""
    out = m
    for name, size in sizes.items():
        kind = m.schema[name].dataType
        out = out.withColumns({f"b{name}": F.floor(F.col(name) / size).cast(kind), name: F.pmod(F.col(name), F.lit(size)).cast(kind)})
    return out


def deblockify(m: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Inverse of blockify, for blocks of the given sizes."""
    out = m
    for name, size in sizes.items():
        out = out.withColumn(name, (F.col(f"b{name}") * size + F.col(name)).cast(m.schema[name].dataType)).drop(f"b{name}")
    return out
