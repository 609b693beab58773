"""Sparse linear algebra: a matrix is (i, j, v), a vector (i, v), cells that are absent are zero.

Products are equi-joins on the contracted index and partial sums; Spark broadcasts a small operand by its size and
splits skewed keys. Matrices may have further key columns. Complex ones have the columns re and im instead of v; all
operators take either, and a product or sum of both kinds is complex.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint


def _complex(m: DataFrame) -> bool:
    return "im" in m.columns


def _parts(m: DataFrame) -> list[str]:
    return ["re", "im"] if _complex(m) else ["v"]


def as_complex(m: DataFrame) -> DataFrame:
    return m if _complex(m) else m.withColumn("im", F.lit(0.0)).withColumnRenamed("v", "re")


def _alike(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (as_complex(a), as_complex(b)) if _complex(a) or _complex(b) else (a, b)


def _times(a: str, b: str, parts: list[str]) -> list[Column]:
    """Sums of products of the parts of two factors, by the prefixes of their columns."""
    x, y = ([F.col(f"{p}{c}") for c in parts] for p in (a, b))
    if len(parts) == 1:
        return [F.sum(x[0] * y[0]).alias("v")]
    return [F.sum(x[0] * y[0] - x[1] * y[1]).alias("re"), F.sum(x[0] * y[1] + x[1] * y[0]).alias("im")]


def _squares(m: DataFrame) -> Column:
    return F.sum(sum((F.col(c) * F.col(c) for c in _parts(m)), F.lit(0.0)))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"), F.lit(1.0).alias("v"))


def diagonal_matrix(v: DataFrame) -> DataFrame:
    return v.select("i", F.col("i").alias("j"), *_parts(v))


def diagonal(m: DataFrame) -> DataFrame:
    return m.where("i = j").select("i", *_parts(m))


def transpose(m: DataFrame) -> DataFrame:
    swap = {"i": "j", "j": "i"}
    return m.select(*[F.col(swap.get(c, c)).alias(c) for c in m.columns])


def row_vector(v: DataFrame) -> DataFrame:
    return v.select(F.lit(0).alias("i"), F.col("i").alias("j"), *_parts(v))


def conjugate(m: DataFrame) -> DataFrame:
    return m.withColumn("im", -F.col("im"))


def adjoint(m: DataFrame) -> DataFrame:
    return conjugate(transpose(m)) if "im" in m.columns else transpose(m)


def scale(m: DataFrame, s: complex) -> DataFrame:
    if isinstance(s, complex) or _complex(m):
        s, m = complex(s), as_complex(m)
        return m.withColumns({"re": F.col("re") * s.real - F.col("im") * s.imag, "im": F.col("re") * s.imag + F.col("im") * s.real})
    return m.withColumn("v", F.col("v") * s)


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = _alike(a, b)
    index = [c for c in a.columns if c not in _parts(a)]
    return a.unionByName(b).groupBy(*index).agg(*[F.sum(c).alias(c) for c in _parts(a)])


def add_scalar(m: DataFrame, s: complex, n: int) -> DataFrame:
    """A scalar beside an n x n matrix stands for that multiple of the identity."""
    one = scale(identity(m.sparkSession, n), s)
    return add(m, one.withColumns({c: F.col(c).cast(m.schema[c].dataType) for c in ("i", "j")}))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return contract(a, b, ["i"])


def contract(a: DataFrame, b: DataFrame, index: list[str], keys: list[str] | None = None, conjugate_a: bool = True) -> DataFrame:
    """Sum of products over all index columns that both have, for each key; the complex form conjugates a."""
    keys = keys or []
    a, b = _alike(a, b)
    parts = _parts(a)
    left = a.select(*keys, *index, *[F.col(c).alias(f"a_{c}") for c in parts])
    rows = left.join(b.select(*keys, *index, *parts), [*keys, *index])
    if parts == ["v"]:
        sums = [F.sum(F.col("a_v") * F.col("v")).alias("v")]
    else:
        s = F.lit(-1.0 if conjugate_a else 1.0)
        sums = [F.sum(F.col("a_re") * F.col("re") - s * F.col("a_im") * F.col("im")).alias("re"), F.sum(F.col("a_re") * F.col("im") + s * F.col("a_im") * F.col("re")).alias("im")]
    return rows.groupBy(*keys).agg(*sums) if keys else rows.agg(*sums)


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = _alike(a, b)
    left = a.select("i", F.col("j").alias("k"), *[F.col(c).alias(f"a_{c}") for c in _parts(a)])
    right = b.select(F.col("i").alias("k"), "j", *[F.col(c).alias(f"b_{c}") for c in _parts(a)])
    return left.join(right, "k").groupBy("i", "j").agg(*_times("a_", "b_", _parts(a)))


def gram(df: DataFrame, column: str) -> DataFrame:
    """i, j, v: the sum over rows of the outer product of a packed vector with itself (the matrix of rows, transposed,
    times itself). Vectors, all of one length, are multiplied a batch at a time; a task passes on one matrix. Null
    vectors count for nothing."""

    def run(batches):
        total = None
        for batch in batches:
            rows = batch.column(0).drop_null()
            if len(rows):
                x = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    return df.select(column).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def block_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Block matrices (bi, bj, i, j, v): block indices contract with block indices, inner ones with inner ones. A 1 x 1
    block beside a larger one is a multiple of the identity; mark it with i and j null."""
    left = a.select("bi", F.col("bj").alias("bk"), "i", F.col("j").alias("k"), "v")
    right = b.select(F.col("bi").alias("bk"), "bj", F.col("i").alias("k2"), "j", F.col("v").alias("w"))
    inner = left.where("k is not null").join(right.where("k2 is not null"), (left["bk"] == right["bk"]) & (F.col("k") == F.col("k2")))
    scalar_left = left.where("k is null").join(right, "bk").select("bi", "bj", F.col("k2").alias("i"), "j", (F.col("v") * F.col("w")).alias("v"))
    scalar_right = left.where("k is not null").join(right.where("k2 is null"), "bk").select("bi", "bj", "i", F.col("k").alias("j"), (F.col("v") * F.col("w")).alias("v"))
    rows = inner.select("bi", "bj", "i", "j", (F.col("v") * F.col("w")).alias("v")).unionByName(scalar_left).unionByName(scalar_right)
    return rows.groupBy("bi", "bj", "i", "j").agg(F.sum("v").alias("v"))


def matrix_vector(m: DataFrame, v: DataFrame) -> DataFrame:
    m, v = _alike(m, v)
    left = m.select("i", F.col("j").alias("k"), *[F.col(c).alias(f"a_{c}") for c in _parts(m)])
    right = v.select(F.col("i").alias("k"), *[F.col(c).alias(f"b_{c}") for c in _parts(m)])
    return left.join(right, "k").groupBy("i").agg(*_times("a_", "b_", _parts(m)))


def product(a: DataFrame, b: DataFrame | complex) -> DataFrame:
    """Dispatch by rank: scalar, vector (no column j) or matrix."""
    if not isinstance(b, DataFrame):
        return scale(a, b)
    if "j" not in a.columns:
        return dot(a, b)
    return matrix_product(a, b) if "j" in b.columns else matrix_vector(a, b)


def matrix_power(m: DataFrame, n: int, size: int) -> DataFrame:
    """Square and multiply; the identity for n <= 0. Products that are used again are checkpointed, so that plans don't
    grow with n."""
    out = None
    while n > 0:
        if n & 1:
            out = m if out is None else matrix_product(out, m)
        n >>= 1
        if n:
            out = out if out is None else checkpoint(out)
            m = checkpoint(matrix_product(m, m))
    if out is None:
        one = identity(m.sparkSession, size)
        return as_complex(one) if _complex(m) else one
    return out


def trace(m: DataFrame) -> DataFrame:
    return m.where("i = j").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in _parts(m)])


def frobenius(m: DataFrame) -> DataFrame:
    return m.agg(F.sqrt(_squares(m)).alias("v"))


def norm(v: DataFrame) -> DataFrame:
    return v.agg(F.sqrt(_squares(v)).alias("v"))


def square_norm(v: DataFrame) -> DataFrame:
    return v.agg(_squares(v).alias("v"))


def determinants(m: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Determinant of each key's size x size matrix, by LU with partial pivoting (numpy): det, or re and im."""
    parts = _parts(m)
    names = ["det"] if parts == ["v"] else parts

    def one(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((size, size), complex if len(parts) == 2 else float)
        for c, unit in zip(parts, (1, 1j)):
            dense[cells["i"].to_numpy(), cells["j"].to_numpy()] += cells[c].to_numpy() * unit
        d = np.linalg.det(dense)
        return pd.DataFrame([[*key, *([d.real, d.imag] if len(parts) == 2 else [float(d)])]], columns=[*keys, *names])

    schema = ", ".join([f"{k} {m.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} double" for c in names])
    return m.groupBy(*keys).applyInPandas(one, schema)


conj, sp, mult, tr, transp, trp, adj, det = conjugate, dot, product, trace, transpose, transpose, adjoint, determinants
