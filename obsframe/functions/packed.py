"""Expressions over array columns. A matrix is an array of row arrays; indices count from 0.

A null array has size 0 but differs from an empty one. Nothing reads past an end: missing elements are null, and the
elementwise functions are null where lengths differ. Everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | int | float


def _c(x: Value) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _d(x: Column) -> Column:
    return x.cast("double")


# Construction


def indices(n: Value) -> Column:
    """[0, ..., n-1]; empty for n = 0, for which sequence() would count down."""
    n = _c(n).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def zeros(n: Value) -> Column:
    return full(n, F.lit(0.0))


def full(n: Value, value: Value) -> Column:
    return F.array_repeat(_c(value), _c(n).cast("int"))


def fill(v: Value, value: Value) -> Column:
    """Every element becomes the value; an empty or null array becomes one element."""
    v = _c(v)
    return F.when(size(v) == 0, F.array(_c(value))).otherwise(F.transform(v, lambda _: _c(value)))


def literal(values: list) -> Column:
    """A (nested) Python list as a constant of doubles."""
    return F.array(*[literal(x) if isinstance(x, list | tuple) else F.lit(float(x)) for x in values])


def convert(v: Value, element: str = "double") -> Column:
    return _c(v).cast(f"array<{element}>")


def generate(n: Value, f: Callable[[Column], Column]) -> Column:
    return F.transform(indices(n), f)


def random(high: float = 1.0, seed: int | None = None) -> Column:
    """Uniform on [0, high), by row; the same for the same seed and partitions."""
    return F.rand(seed) * high


def zero_matrix(rows: Value, columns: Value) -> Column:
    return F.array_repeat(zeros(columns), _c(rows).cast("int"))


def identity(n: Value) -> Column:
    return generate(n, lambda i: generate(n, lambda j: F.when(i == j, 1.0).otherwise(0.0)))


def diagonal_matrix(v: Value, rows: Value | None = None, columns: Value | None = None) -> Column:
    v = _c(v)
    rows, columns = size(v) if rows is None else rows, size(v) if columns is None else columns
    return generate(rows, lambda i: generate(columns, lambda j: F.when(i == j, F.coalesce(F.get(v, i), F.lit(0.0))).otherwise(0.0)))


# Shape and indexing


def size(v: Value) -> Column:
    return F.coalesce(F.when(_c(v).isNotNull(), F.size(_c(v))), F.lit(0))


def shape(v: Value, rank: int) -> Column:
    """Sizes along the first elements."""
    out, at = [], _c(v)
    for k in range(rank):
        out.append(size(at))
        at = F.get(at, F.lit(0)) if k + 1 < rank else at
    return F.array(*out)


def resize(v: Value, n: Value, keep: bool = False) -> Column:
    """n elements: the common prefix if kept, then zeros."""
    v, n = _c(v), _c(n).cast("int")
    if not keep:
        return zeros(n)
    return F.concat(F.slice(v, F.lit(1), n), zeros(F.greatest(n - size(v), F.lit(0))))


def at(v: Value, *index: Value) -> Column:
    """The element, or sub-array, at a multi-index; null outside."""
    return reduce(lambda x, i: F.get(x, _c(i).cast("int")), index, _c(v))


def cyclic(v: Value, i: Value) -> Column:
    return F.when(size(v) > 0, F.get(_c(v), F.pmod(_c(i).cast("int"), size(v))))


def sub_array(v: Value, dimension: int, i: Value) -> Column:
    """Fix the index of one dimension and drop it."""
    if dimension == 0:
        return at(v, i)
    return F.transform(_c(v), lambda x: sub_array(x, dimension - 1, i))


def interval(v: Value, low: Value, high: Value) -> Column:
    """Elements low to high, both included, as far as there are any."""
    v = _c(v)
    low, high = F.greatest(_c(low).cast("int"), F.lit(0)), F.least(_c(high).cast("int"), size(v) - 1)
    return F.slice(v, low + 1, F.greatest(high - low + 1, F.lit(0)))


def rotate(v: Value, offset: Value) -> Column:
    """Element m of the result is element (m + offset) mod n."""
    v = _c(v)
    k = F.when(size(v) > 0, F.pmod(_c(offset).cast("int"), size(v))).otherwise(0)
    return F.concat(F.slice(v, k + 1, F.greatest(size(v), F.lit(1))), F.slice(v, F.lit(1), k))


def shift(v: Value, offset: Value) -> Column:
    """A positive offset moves right behind that many zeros; a negative one drops elements from the front."""
    v, k = _c(v), _c(offset).cast("int")
    return F.when(k >= 0, F.concat(zeros(F.greatest(k, F.lit(0))), v)).otherwise(F.slice(v, 1 - F.least(k, F.lit(0)), F.greatest(size(v), F.lit(1))))


def blockify(v: Value, m: Value) -> Column:
    """Blocks of m elements; a last shorter one if m does not divide the size."""
    v, m = _c(v), _c(m).cast("int")
    return generate(F.ceil(size(v) / m), lambda b: F.slice(v, b * m + 1, m))


def blockify_matrix(v: Value, rows: Value, columns: Value) -> Column:
    """Rank 4: block row, block column, row and column within the block."""
    return F.transform(blockify(v, rows), lambda band: F.transform(indices(F.ceil(size(F.get(band, F.lit(0))) / _c(columns))), lambda c: F.transform(band, lambda r: F.slice(r, c * _c(columns).cast("int") + 1, _c(columns).cast("int")))))


def deblockify(v: Value) -> Column:
    return flatten(v)


def deblockify_matrix(v: Value) -> Column:
    """Inverse of blockify_matrix."""
    rows = lambda band: indices(size(F.get(band, F.lit(0))))
    return F.flatten(F.transform(_c(v), lambda band: F.transform(rows(band), lambda r: F.flatten(F.transform(band, lambda block: F.get(block, r))))))


def flatten(v: Value, levels: int = 1) -> Column:
    return reduce(lambda x, _: F.flatten(x), range(levels), _c(v))


def transpose(m: Value) -> Column:
    m = _c(m)
    return generate(size(F.get(m, F.lit(0))), lambda j: F.transform(m, lambda r: F.get(r, j)))


def row_vector(v: Value) -> Column:
    """A vector as a matrix of one row."""
    return F.array(_c(v))


def diagonal(m: Value) -> Column:
    m = _c(m)
    return generate(F.least(size(m), size(F.get(m, F.lit(0)))), lambda i: F.get(F.get(m, i), i))


# Elementwise


def map_elements(v: Value, f: Callable, depth: int = 1, with_index: bool = False) -> Column:
    """Apply f to what stands `depth` levels down: leaves, rows or blocks. with_index: f(x, i, j, ...) gets the index of
    every level."""

    def walk(x: Column, level: int, index: tuple) -> Column:
        if level == 0:
            return f(x, *index) if with_index else f(x)
        if with_index:
            return F.transform(x, lambda y, i: walk(y, level - 1, (*index, i)))
        return F.transform(x, lambda y: walk(y, level - 1, ()))

    return walk(_c(v), depth, ())


def _both(a: Value, b: Value, op: Callable, depth: int) -> Column:
    a, b = _c(a), _c(b)
    if depth == 0:
        return op(a, b)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: _both(x, y, op, depth - 1)))


OPERATIONS = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.try_divide(x, y)}


def elementwise(a: Value, op: str, b: Value, depth: int = 1) -> Column:
    """array op array; null where lengths differ, and for a division by zero."""
    return _both(a, b, OPERATIONS[op], depth)


def with_scalar(v: Value, op: str, s: Value, depth: int = 1) -> Column:
    return map_elements(v, lambda x: OPERATIONS[op](x, _c(s)), depth)


def scalar_with(s: Value, op: str, v: Value, depth: int = 1) -> Column:
    return map_elements(v, lambda x: OPERATIONS[op](_c(s), x), depth)


def equal(a: Value, b: Value) -> Column:
    return _c(a).eqNullSafe(_c(b))


def sqrt(v: Value, depth: int = 1) -> Column:
    return map_elements(v, F.sqrt, depth)


def power(v: Value, p: Value, depth: int = 1) -> Column:
    return map_elements(v, lambda x: F.pow(x, _c(p)), depth)


def absolute(v: Value, depth: int = 1) -> Column:
    return map_elements(v, F.abs, depth)


def sign(v: Value, depth: int = 1) -> Column:
    return map_elements(v, F.signum, depth)


def visit(f: Callable, *arrays: Value) -> Column:
    """f over the elements of parallel arrays; null beyond the end of a shorter one."""
    longest = F.greatest(*map(size, arrays)) if len(arrays) > 1 else size(arrays[0])
    return generate(longest, lambda i: f(*[F.get(_c(a), i) for a in arrays]))


def first(v: Value) -> Column:
    return F.get(_c(v), F.lit(0))


# Reductions


def _picked(v: Value, low: Value | None, high: Value | None, key: int | None) -> Column:
    v = _c(v) if low is None else interval(v, low, high)
    return v if key is None else F.transform(v, lambda x: F.get(x, F.lit(key)))


def total(v: Value, low: Value | None = None, high: Value | None = None, key: int | None = None) -> Column:
    """Sum over the first level, within an inclusive interval, of one sub-index if key is given; null for no element."""
    v = _picked(v, low, high, key)
    return F.when(size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + _d(x)))


def total_rows(m: Value) -> Column:
    """Sum of a matrix' rows, element by element."""
    m = _c(m)
    return F.aggregate(F.slice(m, F.lit(2), F.greatest(size(m), F.lit(1))), convert(first(m)), lambda s, r: F.zip_with(s, r, lambda x, y: x + _d(y)))


def mean(v: Value, low: Value | None = None, high: Value | None = None, key: int | None = None) -> Column:
    """Mean of the elements that an interval really holds."""
    return total(v, low, high, key) / F.nullif(size(_picked(v, low, high, key)), F.lit(0))


def deviation(v: Value) -> Column:
    """Population standard deviation."""
    v = _c(v)
    m = mean(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (_d(x) - m) * (_d(x) - m)) / F.nullif(size(v), F.lit(0)))


def mean_product(a: Value, b: Value) -> Column:
    """Uncentred: mean of products over the shorter length."""
    n = F.least(size(a), size(b))
    return F.aggregate(F.zip_with(F.slice(_c(a), F.lit(1), n), F.slice(_c(b), F.lit(1), n), lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, p: s + p) / F.nullif(n, F.lit(0))


def weighted_median(v: Value) -> Column:
    """Elements are weights: the last index at which their running sum is no more than half the total, 0 at least."""
    v = _c(v)
    half = total(v) / 2
    step = lambda s, x: F.struct((s["sum"] + _d(x)).alias("sum"), (s["i"] + 1).alias("i"), F.when(s["sum"] + _d(x) <= half, s["i"]).otherwise(s["best"]).alias("best"))
    return F.when(size(v) > 0, F.aggregate(v, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(0).alias("best")), step)["best"])


def maximum(v: Value, depth: int = 1) -> Column:
    return F.array_max(flatten(v, depth - 1))


def minimum(v: Value, depth: int = 1) -> Column:
    return F.array_min(flatten(v, depth - 1))


def maximum_index(v: Value) -> Column:
    """First place of the maximum."""
    return F.nullif((F.array_position(_c(v), F.array_max(_c(v))) - 1).cast("int"), F.lit(-1))


def minimum_index(v: Value) -> Column:
    return F.nullif((F.array_position(_c(v), F.array_min(_c(v))) - 1).cast("int"), F.lit(-1))


def _class(x: Column, n: int, low: float, high: float) -> Column:
    """The last class is closed; null outside."""
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - low) / F.nullif(F.lit(high - low), F.lit(0.0)) * n).cast("int"), F.lit(n - 1)))


def histogram_members(v: Value, n: int, low: float, high: float) -> Column:
    """For each class the indices of its elements, in order."""
    classes = F.transform(_c(v), lambda x: _class(_d(x), n, low, high))
    return generate(n, lambda k: F.filter(indices(size(v)), lambda i: F.get(classes, i) == k))


def histogram(v: Value, n: int, low: float, high: float) -> Column:
    return F.transform(histogram_members(v, n, low, high), F.size)


def sort(v: Value) -> Column:
    return F.array_sort(_c(v))


def argsort(v: Value) -> Column:
    """Indices in ascending order of value; ties by index."""
    pairs = F.transform(_c(v), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


# Linear algebra of small operands


def dot(a: Value, b: Value) -> Column:
    """Bilinear, no conjugation; an operand of one element scales the sum of the other."""
    a, b = _c(a), _c(b)
    summed = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    products = F.zip_with(a, b, lambda x, y: _d(x) * _d(y))
    return (
        F.when(size(a) == size(b), summed(products))
        .when(size(a) == 1, total(b) * _d(first(a)))
        .when(size(b) == 1, total(a) * _d(first(b)))
    )


def matrix_vector(m: Value, v: Value) -> Column:
    return F.transform(_c(m), lambda r: F.aggregate(F.zip_with(r, _c(v), lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, p: s + p))


def matrix_product(a: Value, b: Value) -> Column:
    """Rows of a against columns of b, which is transposed once."""
    columns = transpose(b)
    return F.transform(_c(a), lambda r: F.transform(columns, lambda c: F.aggregate(F.zip_with(r, c, lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, p: s + p)))


def trace(m: Value) -> Column:
    return F.aggregate(diagonal(m), F.lit(0.0), lambda s, x: s + _d(x))


def square_norm(v: Value) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + _d(x) * _d(x))


def norm(v: Value) -> Column:
    return F.sqrt(square_norm(v))


def frobenius(m: Value) -> Column:
    return norm(F.flatten(_c(m)))


def determinant_small(m: Value, n: int) -> Column:
    """Closed form for n = 1, 2, 3."""
    e = lambda i, j: _d(at(m, i, j))
    if n == 1:
        return e(0, 0)
    if n == 2:
        return e(0, 0) * e(1, 1) - e(0, 1) * e(1, 0)
    if n == 3:
        return sum((e(0, j) * (e(1, (j + 1) % 3) * e(2, (j + 2) % 3) - e(1, (j + 2) % 3) * e(2, (j + 1) % 3)) for j in range(1, 3)), e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1)))
    raise ValueError("use operators.linear.determinants for larger matrices")


# Text


def join_text(v: Value, separator: str = " ") -> Column:
    return F.array_join(F.transform(_c(v), lambda x: x.cast("string")), separator)


def lines_text(m: Value) -> Column:
    return F.array_join(F.transform(_c(m), lambda r: join_text(r)), "\n")


def braces_text(v: Value, rank: int) -> Column:
    """{{1,2},{3,4}}"""
    if rank == 0:
        return _c(v).cast("string")
    return F.concat(F.lit("{"), F.array_join(F.transform(_c(v), lambda x: braces_text(x, rank - 1)), ","), F.lit("}"))
