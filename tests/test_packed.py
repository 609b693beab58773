"""Packed arrays: golden values and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from obsframe.functions import complexes as C
from obsframe.functions import packed as P


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first()["x"]


def rows(x):
    return [rows(y) for y in x] if isinstance(x, list) else x


def test_construction(value):
    assert value(P.zeros(0)) == [] and value(P.zeros(2)) == [0, 0]
    assert value(P.indices(0)) == [] and value(P.generate(3, lambda i: i * i)) == [0, 1, 4]
    assert value(P.fill(P.literal([1, 2]), 7.0)) == [7, 7] and value(P.fill(F.lit(None).cast("array<double>"), 7.0)) == [7]
    assert value(P.zero_matrix(1, 2)) == [[0, 0]] and value(P.identity(2)) == [[1, 0], [0, 1]]
    assert value(P.diagonal_matrix(P.literal([5, 6]), 2, 3)) == [[5, 0, 0], [0, 6, 0]]


def test_shape_and_null(value):
    M = P.literal([[1, 2], [3, 4]])  # noqa: N806
    null = F.lit(None).cast("array<double>")
    assert value(P.size(null)) == 0 and value(P.size(P.zeros(0))) == 0
    assert value(P.shape(M, 2)) == [2, 2]
    assert value(P.at(M, 1, 0)) == 3 and value(P.at(M, 5, 0)) is None and value(P.at(M, 0, 9)) is None
    assert value(P.resize(P.literal([1, 2, 3]), 2, keep=True)) == [1, 2] and value(P.resize(P.literal([1]), 3, keep=True)) == [1, 0, 0]
    assert value(P.cyclic(P.literal([1, 2, 3]), -1)) == 3 and value(P.cyclic(P.zeros(0), 1)) is None


def test_slices(value):
    M = P.literal([[1, 2], [3, 4]])  # noqa: N806
    v = P.literal(list(range(16)))
    assert value(P.interval(v, -3, 1)) == [0, 1] and value(P.interval(v, 14, 99)) == [14, 15] and value(P.interval(v, 5, 4)) == []
    assert value(P.rotate(v, 10)) == [float((i + 10) % 16) for i in range(16)]
    assert value(P.rotate(v, -4)) == [float((i - 4) % 16) for i in range(16)]
    assert value(P.rotate(P.zeros(0), 3)) == []
    assert value(P.shift(P.literal([1, 2]), 1)) == [0, 1, 2] and value(P.shift(P.literal([1, 2]), -1)) == [2]
    assert value(P.blockify(P.literal([1, 2, 3]), 2)) == [[1, 2], [3]]
    assert value(P.deblockify(P.blockify(v, 5))) == [float(i) for i in range(16)]
    m = P.blockify(v, 4)
    assert value(P.deblockify_matrix(P.blockify_matrix(m, 2, 2))) == value(m)
    assert value(P.flatten(P.literal([[1], [2, 3]]))) == [1, 2, 3]
    assert value(P.sub_array(M, 1, 0)) == [1, 3] and value(P.sub_array(M, 0, 1)) == [3, 4]
    assert value(P.transpose(M)) == [[1, 3], [2, 4]] and value(P.transpose(P.literal([[1, 2], [3, 4], [5, 6]]))) == [[1, 3, 5], [2, 4, 6]]


def test_elementwise(value):
    M = P.literal([[1, 2], [3, 4]])  # noqa: N806
    a, b = P.literal([1, 2]), P.literal([4, 0])
    assert value(P.elementwise(a, "+", b)) == [5, 2] and value(P.elementwise(a, "/", b)) == [0.25, None]
    assert value(P.elementwise(a, "*", P.literal([1]))) is None
    assert value(P.elementwise(M, "-", M, depth=2)) == [[0, 0], [0, 0]]
    assert value(P.scalar_with(1, "-", a)) == [0, -1]
    assert value(P.map_elements(M, lambda x, i, j: i * 10 + j, depth=2, with_index=True)) == [[0, 1], [10, 11]]
    assert value(P.map_elements(M, lambda row: P.total(row))) == [3, 7]
    assert math.isnan(value(P.sqrt(P.literal([-1])))[0])
    assert value(P.visit(lambda x, y: x + y, a, P.literal([1]))) == [2, None]
    assert value(P.equal(a, a)) is True and value(P.equal(a, F.lit(None).cast("array<double>"))) is False
    cube = P.map_elements(P.literal([[[0] * 3] * 3] * 3), lambda x, i, j, k: i * 9 + j * 3 + k, depth=3, with_index=True)
    assert value(P.flatten(cube, 2)) == list(range(27))


def test_reductions(value):
    M = P.literal([[1, 2], [3, 4]])  # noqa: N806
    v = P.literal([3, 1, 2])
    assert value(P.total(v)) == 6 and value(P.total(P.zeros(0))) is None and value(P.total(v, 1, 9)) == 3
    assert value(P.mean(v, 1, 9)) == 1.5 and value(P.total(M, key=1)) == 6 and value(P.total_rows(M)) == [4, 6]
    assert value(P.deviation(P.literal([1, 2, 3, 4]))) == pytest.approx(math.sqrt(1.25))
    assert value(P.mean_product(v, P.literal([1, 1]))) == 2
    assert value(P.weighted_median(P.literal([1, 1, 2, 5, 1]))) == 2 and value(P.weighted_median(P.literal([9, 1]))) == 0
    assert value(P.maximum_index(P.literal([1, 5, 5]))) == 1 and value(P.minimum_index(P.zeros(0))) is None
    assert value(P.histogram(P.literal([-1, 0, 1, 2.5, 5, 9.99, 10, 11]), 5, 0, 10)) == [2, 1, 1, 0, 2]
    assert value(P.histogram_members(P.literal([-1, 0, 1, 2.5, 5, 9.99, 10, 11]), 5, 0, 10)) == [[1, 2], [3], [4], [], [5, 6]]
    assert value(P.sort(P.literal([7]))) == [7] and value(P.argsort(P.literal([7]))) == [0]
    assert value(P.argsort(P.literal([2, 1, 2, 0]))) == [3, 1, 0, 2]


def test_linear_algebra(value):
    M = P.literal([[1, 2], [3, 4]])  # noqa: N806
    v = P.literal([10, 20])
    assert value(P.dot(v, v)) == 500 and value(P.dot(P.literal([2]), v)) == 60 and value(P.dot(v, P.literal([1, 2, 3]))) is None
    assert value(P.matrix_vector(M, v)) == [50, 110] and value(P.dot(v, P.matrix_vector(M, v))) == 2700
    n = P.literal([[1, 2], [3, 4], [5, 6]])
    assert value(P.matrix_vector(n, v)) == [50, 110, 170] and value(P.dot(P.literal([10, 20, 30]), P.matrix_vector(n, v))) == 7800
    assert value(P.matrix_product(M, M)) == [[7, 10], [15, 22]] and value(P.trace(M)) == 5
    assert value(P.frobenius(M)) == pytest.approx(math.sqrt(30)) and value(P.square_norm(v)) == 500
    assert value(P.determinant_small(M, 2)) == -2 and value(P.determinant_small(P.literal([[1, 1], [0, 2]]), 2)) == 2
    assert value(P.determinant_small(P.literal([[2, 0, 1], [1, 3, 2], [1, 1, 1]]), 3)) == pytest.approx(0)


def test_complex(value):
    z = F.array(C.make(3, 4), C.make(0, -1))
    assert value(C.array_imag(C.array_conjugate(z))) == [-4, 1] and value(C.array_modulus(z)) == [5, 1]
    assert value(C.array_imag(P.literal([1, 2]), is_complex=False)) == [0, 0]
    assert value(C.multiply(C.make(1, 2), C.make(3, -1))) == (5, 5) and value(C.add(C.make(1, 2), C.make(3, -1))) == (4, 1)
    assert value(C.deviation(F.array(C.make(1), C.make(2), C.make(3), C.make(4)))) == pytest.approx(math.sqrt(1.25))
    assert value(C.text(C.make(1, 2))) == "1.0+i*2.0"


def test_text(value):
    M = P.literal([[1, 2], [3, 4]])  # noqa: N806
    assert value(P.braces_text(M, 2)) == "{{1.0,2.0},{3.0,4.0}}"
    assert value(P.join_text(P.literal([1, 2]))) == "1.0 2.0" and value(P.lines_text(M)) == "1.0 2.0\n3.0 4.0"
