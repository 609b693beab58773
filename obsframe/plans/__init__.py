"""What a schema says about a tensor, and the way between the packed and the long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Beyond so many cells a row, the long form spreads work over tasks that one row cannot.
PACKED_CELLS = 100_000


def rank(kind: T.DataType) -> int:
    """Nesting depth of arrays."""
    return 1 + rank(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def leaf_type(kind: T.DataType) -> T.DataType:
    return leaf_type(kind.elementType) if isinstance(kind, T.ArrayType) else kind


def tensor_type(levels: int, leaf: T.DataType | None = None) -> T.DataType:
    return T.ArrayType(tensor_type(levels - 1, leaf)) if levels else leaf or T.DoubleType()


def column_rank(df: DataFrame, column: str) -> int:
    return rank(df.schema[column].dataType)


def to_long(df: DataFrame, column: str, index: list[str] | None = None, value: str = "v") -> DataFrame:
    """One row a cell: other columns, index columns i0, i1, ..., value. Null and empty arrays have no cells."""
    depth = column_rank(df, column)
    index = index or [f"i{k}" for k in range(depth)]
    keys = [c for c in df.columns if c != column]
    out = df.withColumnRenamed(column, value)
    for k, name in enumerate(index):
        out = out.select(*keys, *index[:k], F.posexplode(value).alias(name, value))
    return out


def to_packed(df: DataFrame, keys: list[str], index: list[str], value: str = "v", name: str = "v") -> DataFrame:
    """Arrays of the cells in index order, one level after the other. Partial sums bound nothing here: a packed row
    holds its whole tensor, so use this for tensors of up to PACKED_CELLS cells."""
    out = df.select(*keys, *index, F.col(value).alias(name))
    for k in range(len(index) - 1, -1, -1):
        pairs = F.array_sort(F.collect_list(F.struct(F.col(index[k]).alias("i"), F.col(name).alias("x"))))
        out = out.groupBy(*keys, *index[:k]).agg(F.transform(pairs, lambda p: p["x"]).alias(name)) if keys or index[:k] else out.agg(F.transform(pairs, lambda p: p["x"]).alias(name))
    return out


def prefers_long(cells: int) -> bool:
    return cells > PACKED_CELLS


def null_or(c: Column, value) -> Column:
    return F.coalesce(c, F.lit(value))
