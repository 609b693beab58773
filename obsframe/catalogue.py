"""Queries over the driver's tables, one or more for each operator, and the same in DuckDB's SQL.

Doubles are rounded on both sides, as engines add in different orders.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans
from .functions import complexes as C
from .functions import packed as P
from .operators import arrays, calculus, fit, linear, observables, signal, statistics
from .operators.order import running_sum
from .sources import text
from .streaming.moments import windowed_moments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded; minus zero becomes zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rv(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: r(x, digits))


# Packed arrays: one query over `embeddings` for a group of expressions, as text where DuckDB's types differ.

EMB = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", P.convert("embedding").alias("v"))


def packed(name: str, sql: str, columns: Callable[[], dict[str, Column]]) -> None:
    """A query of expressions over v, made once a session exists, and DuckDB's expressions for the same names."""
    QUERIES[name] = lambda spark, sf_dir: embeddings(spark, sf_dir).select("vec_id", *[c.alias(k) for k, c in columns().items()])
    ORACLE[name] = f"SELECT vec_id, {sql} FROM {EMB}"


def vround(e: str, digits: int = 6) -> str:
    return f"list_transform({e}, lambda x: round(x, {digits}) + 0.0)"


packed("S12_zeros", "list_transform(range(vec_id % 5), lambda x: 0.0::DOUBLE) AS z", lambda: {"z": P.zeros(F.col("vec_id") % 5)})
packed("S13_constant", "list_transform(range(vec_id % 4), lambda x: 2.5::DOUBLE) AS z", lambda: {"z": P.full(F.col("vec_id") % 4, 2.5)})
packed("S14_fill", "list_transform(v, lambda x: vec_id::DOUBLE) AS z", lambda: {"z": P.fill("v", F.col("vec_id").cast("double"))})
packed("S15_literal", "[1.0::DOUBLE, 2.0::DOUBLE, 4.0::DOUBLE] AS a, list_transform(v, lambda x: (x * 100)::BIGINT // 1) AS b", lambda: {"a": P.literal([1, 2, 4]), "b": F.transform(F.col("v"), lambda x: F.rint(x * 100).cast("long"))})
packed("S16_generate", "list_transform(range(vec_id % 6), lambda i: i * i + vec_id) AS z", lambda: {"z": P.generate(F.col("vec_id") % 6, lambda i: i.cast("long") * i + F.col("vec_id"))})
packed("S17_zero_matrix", "list_transform(range(2), lambda i: list_transform(range(vec_id % 3), lambda j: 0.0::DOUBLE)) AS z", lambda: {"z": P.zero_matrix(2, F.col("vec_id") % 3)})
packed("X01_size", "len(v)::INTEGER AS n", lambda: {"n": P.size("v")})
packed("X02_shape", "[(len(v) // 8)::INTEGER, 8] AS s", lambda: {"s": P.shape(P.blockify("v", 8), 2)})
packed("X04_resize", f"{vround('list_concat(v[1:60], [])')} AS a, {vround('list_concat(v, [0.0::DOUBLE, 0.0::DOUBLE])')} AS b", lambda: {"a": rv(P.resize("v", 60, keep=True)), "b": rv(P.resize("v", P.size("v") + 2, keep=True))})
packed("X05_element", "round(v[4], 6) + 0.0 AS a, v[1000] AS b", lambda: {"a": r(P.at("v", 3)), "b": P.at("v", 999)})
packed("X06_X07_multi_index", "round(v[8 * 2 + 5 + 1], 6) + 0.0 AS a", lambda: {"a": r(P.at(P.blockify("v", 8), 2, 5))})
packed("X08_sub_array", f"{vround('list_transform(range(len(v) // 8), lambda b: v[b * 8 + 4])')} AS a, {vround('v[17:24]')} AS b", lambda: {"a": rv(P.sub_array(P.blockify("v", 8), 1, 3)), "b": rv(P.sub_array(P.blockify("v", 8), 0, 2))})
packed("X09_interval", f"{vround('v[6:10]')} AS a, {vround('v[63:64]')} AS b", lambda: {"a": rv(P.interval("v", 5, 9)), "b": rv(P.interval("v", 62, 99))})
packed("X10_shift", f"{vround('list_concat(v[11:64], v[1:10])')} AS a, {vround('list_concat([0.0::DOUBLE, 0.0::DOUBLE], v)')} AS b, {vround('v[4:64]')} AS c, {vround('list_concat(v[62:64], v[1:61])')} AS d", lambda: {"a": rv(P.rotate("v", 10)), "b": rv(P.shift("v", 2)), "c": rv(P.shift("v", -3)), "d": rv(P.rotate("v", -3))})
packed("X11_blockify", f"list_transform(range(4), lambda b: {vround('v[b * 16 + 1:b * 16 + 16]')}) AS b", lambda: {"b": F.transform(P.blockify("v", 16), lambda x: rv(x))})
packed("X12_deblockify", f"{vround('v')} AS a, {vround('v')} AS b", lambda: {"a": rv(P.deblockify(P.blockify("v", 12))), "b": rv(P.flatten(P.deblockify_matrix(P.blockify_matrix(P.blockify("v", 8), 4, 2))))})
packed("X13_flatten", f"{vround('v')} AS a", lambda: {"a": rv(P.flatten(P.blockify("v", 7)))})
packed("X14_transpose_packed", f"list_transform(range(8), lambda j: {vround('list_transform(range(8), lambda b: v[b * 8 + j + 1])')}) AS t", lambda: {"t": F.transform(P.transpose(P.blockify("v", 8)), lambda x: rv(x))})
packed("X15_row_vector", f"[{vround('v')}] AS m", lambda: {"m": P.row_vector(rv(F.col("v")))})
packed("X16_diagonal", f"{vround('list_transform(range(8), lambda i: v[i * 9 + 1])')} AS d", lambda: {"d": rv(P.diagonal(P.blockify("v", 8)))})
packed("X19_cyclic", "round(v[(vec_id % 64) + 1], 6) + 0.0 AS a, round(v[((vec_id * 7 + 500) % 64) + 1], 6) + 0.0 AS b", lambda: {"a": r(P.cyclic("v", F.col("vec_id"))), "b": r(P.cyclic("v", F.col("vec_id") * 7 + 500))})
packed("M01_map_index", f"{vround('list_transform(v, lambda x, i: x * (i - 1))')} AS a, list_transform(range(8), lambda b: {vround('list_transform(v[b * 8 + 1:b * 8 + 8], lambda x, j: x + b * 10 + j - 1)')}) AS m", lambda: {"a": rv(P.map_elements("v", lambda x, i: x * i, with_index=True)), "m": F.transform(P.map_elements(P.blockify("v", 8), lambda x, i, j: x + i * 10 + j, depth=2, with_index=True), lambda x: rv(x))})
packed("M02_U01_map", f"{vround('list_transform(v, lambda x: x * x + 1)')} AS a, {vround('list_transform(range(8), lambda b: list_sum(v[b * 8 + 1:b * 8 + 8]))')} AS rows", lambda: {"a": rv(P.map_elements("v", lambda x: x * x + 1)), "rows": rv(P.map_elements(P.blockify("v", 8), lambda row: P.total(row)))})
packed("M03_M05_with_scalar", ", ".join(f"{vround(f'list_transform(v, lambda x: {e})')} AS {n}" for n, e in (("a", "x + 2"), ("b", "x - 2"), ("c", "x * 2"), ("d", "x / 2"), ("e", "2 - x"), ("f", "1 / (x + 10)"))), lambda: {"a": rv(P.with_scalar("v", "+", 2)), "b": rv(P.with_scalar("v", "-", 2)), "c": rv(P.with_scalar("v", "*", 2)), "d": rv(P.with_scalar("v", "/", 2)), "e": rv(P.scalar_with(2, "-", "v")), "f": rv(P.scalar_with(1, "/", P.with_scalar("v", "+", 10)))})
_PAIR = "list_transform(range(1, 65), lambda i: v[i] {op} (v[65 - i] + 3))"
packed("M04_M06_elementwise", ", ".join(f"{vround(_PAIR.format(op=op))} AS {n}" for n, op in (("a", "+"), ("b", "-"), ("c", "*"), ("d", "/"))), lambda: {n: rv(P.elementwise("v", op, P.with_scalar(F.reverse("v"), "+", 3))) for n, op in (("a", "+"), ("b", "-"), ("c", "*"), ("d", "/"))})
packed("M07_equal", "TRUE AS a, list_reverse(v) = v AS b", lambda: {"a": P.equal("v", "v"), "b": P.equal("v", F.reverse("v"))})
packed("M08_M09_M10_M12_M13_unary", ", ".join(f"{vround(f'list_transform(v, lambda x: {e})')} AS {n}" for n, e in (("a", "sqrt(abs(x))"), ("b", "pow(x, 3)"), ("c", "abs(x)"), ("d", "sign(x)::DOUBLE"))), lambda: {"a": rv(P.sqrt(P.absolute("v"))), "b": rv(P.power("v", 3)), "c": rv(P.absolute("v")), "d": rv(P.sign("v"))})
packed("M14_U03_visit", f"{vround('list_transform(range(1, 65), lambda i: v[i] + 2 * v[65 - i] + v[i] * v[i])')} AS a", lambda: {"a": rv(P.visit(lambda x, y, z: x + 2 * y + z, "v", F.reverse("v"), P.power("v", 2)))})
packed("M15_first", "round(v[1], 6) + 0.0 AS a", lambda: {"a": r(P.first("v"))})
packed("G01_G02_G03_G04_sum_mean", "round(list_sum(v), 6) + 0.0 AS a, round(list_sum(v[4:11]), 6) + 0.0 AS b, round(list_avg(v), 6) + 0.0 AS c, round(list_avg(v[61:64]), 6) + 0.0 AS d, round(list_sum(list_transform(range(8), lambda b: v[b * 8 + 3])), 6) + 0.0 AS k, " + vround("list_transform(range(8), lambda j: list_sum(list_transform(range(8), lambda b: v[b * 8 + j + 1])))") + " AS rows", lambda: {"a": r(P.total("v")), "b": r(P.total("v", 3, 10)), "c": r(P.mean("v")), "d": r(P.mean("v", 60, 90)), "k": r(P.total(P.blockify("v", 8), key=2)), "rows": rv(P.total_rows(P.blockify("v", 8)))})
packed("G05_sd_packed", "round(list_stddev_pop(v), 6) + 0.0 AS a", lambda: {"a": r(P.deviation("v"))})
packed("G07_mean_product_packed", "round(list_avg(list_transform(range(1, 65), lambda i: v[i] * v[65 - i])), 6) + 0.0 AS a", lambda: {"a": r(P.mean_product("v", F.reverse("v")))})
packed("G10_weighted_median_packed", "(SELECT coalesce(max(i - 1), 0)::INTEGER FROM (SELECT i, list_sum(list_transform(v[1:i], lambda x: round(abs(x) * 1000)::BIGINT)) AS c FROM (SELECT unnest(range(1, 65)) AS i)) WHERE c * 2 <= list_sum(list_transform(v, lambda x: round(abs(x) * 1000)::BIGINT))) AS m", lambda: {"m": P.weighted_median(F.transform(F.col("v"), lambda x: F.round(F.abs(x) * 1000).cast("long")))})
packed("G11_G12_G13_extremes", "round(list_max(v), 6) + 0.0 AS a, round(list_min(v), 6) + 0.0 AS b, (list_position(v, list_max(v)) - 1)::INTEGER AS i, (list_position(v, list_min(v)) - 1)::INTEGER AS j, round(list_max(v), 6) + 0.0 AS deep", lambda: {"a": r(P.maximum("v")), "b": r(P.minimum("v")), "i": P.maximum_index("v"), "j": P.minimum_index("v"), "deep": r(P.maximum(P.blockify("v", 8), 2))})
_CLASS = "least(3, floor((v[i] + 0.25) / 0.5 * 4)::INTEGER)"
packed("G14_G15_histogram_packed", f"list_transform(range(4), lambda k: len(list_filter(range(1, 65), lambda i: v[i] >= -0.25 AND v[i] <= 0.25 AND {_CLASS} = k))::INTEGER) AS h, list_transform(range(4), lambda k: list_transform(list_filter(range(1, 65), lambda i: v[i] >= -0.25 AND v[i] <= 0.25 AND {_CLASS} = k), lambda i: (i - 1)::INTEGER)) AS members", lambda: {"h": P.histogram("v", 4, -0.25, 0.25), "members": P.histogram_members("v", 4, -0.25, 0.25)})
packed("O01_argsort", "list_transform(list_sort(list_transform(range(1, 65), lambda i: {'x': v[i], 'i': i - 1})), lambda s: s.i::INTEGER) AS a", lambda: {"a": P.argsort("v")})
packed("O02_sort", f"{vround('list_sort(v)')} AS a", lambda: {"a": rv(P.sort("v"))})
packed("L01_L02_L03_dot", "round(list_dot_product(v, list_reverse(v)), 6) + 0.0 AS a, round(list_sum(v) * 3, 6) + 0.0 AS b", lambda: {"a": r(P.dot("v", F.reverse("v"))), "b": r(P.dot(P.literal([3]), "v"))})
packed("L06_L08_small_products", f"list_transform(range(8), lambda i: {vround('list_transform(range(8), lambda j: list_sum(list_transform(range(8), lambda k: v[i * 8 + k + 1] * v[k * 8 + j + 1])))')}) AS m, {vround('list_transform(range(8), lambda i: list_sum(list_transform(range(8), lambda k: v[i * 8 + k + 1] * v[k + 1])))')} AS w", lambda: {"m": F.transform(P.matrix_product(P.blockify("v", 8), P.blockify("v", 8)), lambda x: rv(x)), "w": rv(P.matrix_vector(P.blockify("v", 8), P.interval("v", 0, 7)))})
packed("L12_det_closed", "round(v[1] * v[4] - v[2] * v[3], 6) + 0.0 AS a, round(v[1] * (v[5] * v[9] - v[6] * v[8]) - v[2] * (v[4] * v[9] - v[6] * v[7]) + v[3] * (v[4] * v[8] - v[5] * v[7]), 6) + 0.0 AS b", lambda: {"a": r(P.determinant_small(P.blockify(P.interval("v", 0, 3), 2), 2)), "b": r(P.determinant_small(P.blockify(P.interval("v", 0, 8), 3), 3))})
packed("G16_G17_G18_G19_G20_norms", "round(list_sum(list_transform(range(8), lambda i: v[i * 9 + 1])), 6) + 0.0 AS tr, round(v[1] * v[1], 6) + 0.0 AS one, round(sqrt(list_dot_product(v, v)), 6) + 0.0 AS fro, round(sqrt(list_dot_product(v, v)), 6) + 0.0 AS euc, round(list_dot_product(v, v), 6) + 0.0 AS can", lambda: {"tr": r(P.trace(P.blockify("v", 8))), "one": r(P.first("v") * P.first("v")), "fro": r(P.frobenius(P.blockify("v", 8))), "euc": r(P.norm("v")), "can": r(P.square_norm("v"))})
_INTS = "list_transform(v, lambda x: round(x * 100)::BIGINT)"
packed("S09_S10_S11_text", f"array_to_string({_INTS}, ' ') AS flat, '{{' || array_to_string(list_transform(range(8), lambda b: '{{' || array_to_string({_INTS}[b * 8 + 1:b * 8 + 8], ',') || '}}'), ',') || '}}' AS braces, array_to_string(list_transform(range(8), lambda b: array_to_string({_INTS}[b * 8 + 1:b * 8 + 8], ' ')), chr(10)) AS lines", lambda: (lambda ints: {"flat": P.join_text(ints), "braces": P.braces_text(P.blockify(ints, 8), 2), "lines": P.lines_text(P.blockify(ints, 8))})(F.transform(F.col("v"), lambda x: F.round(x * 100).cast("long"))))

# Complex numbers: pairs of neighbours as real and imaginary part.

def pairs() -> Column:
    return F.transform(P.blockify("v", 2), lambda p: C.make(P.at(p, 0), P.at(p, 1)))



_RE, _IM = "list_transform(range(32), lambda i: v[2 * i + 1])", "list_transform(range(32), lambda i: v[2 * i + 2])"
packed("X17_real_imag", f"{vround(_RE)} AS re, {vround(_IM)} AS im, list_transform(v, lambda x: 0.0::DOUBLE) AS none, {vround(_RE)} AS re2, {vround(_IM)} AS im2", lambda: {"re": rv(C.array_real(pairs())), "im": rv(C.array_imag(pairs())), "none": C.array_imag("v", is_complex=False), "re2": rv(C.array_real(C.array_real_complex(pairs()))), "im2": rv(C.array_real(C.array_imag_complex(pairs())))})
packed("M10_M11_complex", f"{vround('list_transform(range(32), lambda i: sqrt(v[2 * i + 1] ** 2 + v[2 * i + 2] ** 2))')} AS modulus, {vround('list_transform(range(32), lambda i: -v[2 * i + 2])')} AS conj, {vround('list_transform(range(32), lambda i: v[2 * i + 1] ** 2 + v[2 * i + 2] ** 2)')} AS square", lambda: {"modulus": rv(C.array_modulus(pairs())), "conj": rv(C.array_imag(C.array_conjugate(pairs()))), "square": rv(F.transform(pairs(), lambda z: C.real(C.multiply(z, C.conjugate(z)))))})
packed("G05_sd_complex", f"round(sqrt(list_dot_product(v, v) / 32 - (pow(list_sum({_RE}), 2) + pow(list_sum({_IM}), 2)) / 1024), 6) + 0.0 AS sd", lambda: {"sd": r(C.deviation(pairs()))})


@query("X03_rank", "SELECT 'vec_id' AS name, 0 AS rank UNION ALL SELECT 'embedding', 1 UNION ALL SELECT 'label', 0")
def _rank(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return spark.createDataFrame([(c, plans.column_rank(df, c)) for c in df.columns], "name string, rank int")


@query("X01_forms_round_trip", f"SELECT vec_id, {vround('v')} AS v FROM {EMB}")
def _forms(spark, sf_dir):
    long = plans.to_long(embeddings(spark, sf_dir), "v")
    return plans.to_packed(long.withColumn("v", r("v")), ["vec_id"], ["i0"])


# Generated matrices


@query("S18_identity", "SELECT i::INTEGER AS i, i::INTEGER AS j, 1.0::DOUBLE AS v FROM range(50) t(i)")
def _identity(spark, sf_dir):
    return linear.identity(spark, 50)


NATION = "(SELECT c_nationkey AS i, row_number() OVER (ORDER BY s) - 1 AS j0, s FROM (SELECT DISTINCT c_nationkey, c_mktsegment AS s FROM customer))"
#: Nation x nation: how customers' and suppliers' balances meet in regions; and a vector of suppliers' balances.
MATRIX = "(SELECT c_nationkey::BIGINT AS i, (c_custkey % 25)::BIGINT AS j, round(sum(c_acctbal) / 1000, 3) AS v FROM customer GROUP BY ALL)"
VECTOR = "(SELECT s_nationkey::BIGINT AS i, round(sum(s_acctbal) / 1000, 3) AS v FROM supplier GROUP BY ALL)"


def matrix(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").cast("long").alias("i"), (F.col("c_custkey") % 25).alias("j")).agg(F.round(F.sum("c_acctbal") / 1000, 3).alias("v"))


def vector(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("i")).agg(F.round(F.sum("s_acctbal") / 1000, 3).alias("v"))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def matrix_query(name: str, sql: str, f: Callable[[DataFrame, DataFrame], DataFrame], digits: int = 4) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(f(matrix(spark, sf_dir), vector(spark, sf_dir)), digits)
    ORACLE[name] = f"WITH m AS {MATRIX}, x AS {VECTOR} {sql}"


#: Products of values with three decimals have six: rounded at seven, none lies on a tie.
_R = "round(sum({}), 7) + 0.0 AS v"
matrix_query("S19_diag_matrix", "SELECT i, i AS j, round(v, 4) + 0.0 AS v FROM x", lambda m, x: linear.diagonal_matrix(x))
matrix_query("X14_transpose", "SELECT j AS i, i AS j, round(v, 4) + 0.0 AS v FROM m", lambda m, x: linear.transpose(m))
matrix_query("X15_transpose_vector", "SELECT 0 AS i, i AS j, round(v, 4) + 0.0 AS v FROM x", lambda m, x: linear.row_vector(x))
matrix_query("X16_diag", "SELECT i, round(v, 4) + 0.0 AS v FROM m WHERE i = j", lambda m, x: linear.diagonal(m))
matrix_query("L02_dot_long", f"SELECT {_R.format('a.v * b.v')} FROM x a JOIN x b USING (i)", lambda m, x: linear.product(x, x), 7)
matrix_query("L04_contraction", f"SELECT {_R.format('a.v * b.v')} FROM m a JOIN m b ON a.i = b.j AND a.j = b.i", lambda m, x: linear.contract(m, linear.transpose(m), ["i", "j"]), 7)
matrix_query("L05_scale", "SELECT i, j, round(v * 2.5, 5) + 0.0 AS v FROM m", lambda m, x: linear.product(m, 2.5), 5)
matrix_query("L06_L07_matmul", "SELECT a.i, b.j, round(sum(a.v * b.v), 7) + 0.0 AS v FROM m a JOIN m b ON a.j = b.i GROUP BY ALL", lambda m, x: linear.product(m, m), 7)
matrix_query("L06_block_product", "SELECT a.i // 5 AS bi, b.j // 5 AS bj, a.i % 5 AS i, b.j % 5 AS j, round(sum(a.v * b.v), 7) + 0.0 AS v FROM m a JOIN m b ON a.j = b.i GROUP BY ALL", lambda m, x: (lambda b: linear.block_product(b, b))(arrays.blockify(m, {"i": 5, "j": 5})), 7)
matrix_query("L08_matvec", f"SELECT m.i, {_R.format('m.v * x.v')} FROM m JOIN x ON m.j = x.i GROUP BY ALL", lambda m, x: linear.product(m, x), 7)
matrix_query("L09_add_scalar", "SELECT i, j, round(sum(v), 4) + 0.0 AS v FROM (SELECT * FROM m UNION ALL SELECT i, i, 1.5 FROM range(25) t(i)) GROUP BY ALL", lambda m, x: linear.add_scalar(m, 1.5, 25))
matrix_query("L10_adjoint", "SELECT j AS i, i AS j, round(v, 4) + 0.0 AS re, round(-v * (i - j), 4) + 0.0 AS im FROM m", lambda m, x: linear.adj(m.select("i", "j", F.col("v").alias("re"), (F.col("v") * (F.col("i") - F.col("j"))).alias("im"))))
matrix_query("L11_matrix_power", "SELECT a.i, c.j, round(sum(a.v * b.v * c.v) / 1e6, 4) + 0.0 AS v FROM m a JOIN m b ON a.j = b.i JOIN m c ON b.j = c.i GROUP BY ALL", lambda m, x: linear.scale(linear.matrix_power(m, 3, 25), 1e-6))
matrix_query("L11_power_zero", "SELECT i::INTEGER AS i, i::INTEGER AS j, 1.0::DOUBLE AS v FROM range(25) t(i)", lambda m, x: linear.matrix_power(m, 0, 25))
matrix_query("L13_shorthands", "SELECT round(sum(v), 4) + 0.0 AS v FROM m WHERE i = j", lambda m, x: linear.tr(linear.transp(m)))
matrix_query("G16_trace", "SELECT round(sum(v), 4) + 0.0 AS v FROM m WHERE i = j", lambda m, x: linear.trace(m))
matrix_query("G18_frobenius", "SELECT round(sqrt(sum(v * v)), 4) + 0.0 AS v FROM m", lambda m, x: linear.frobenius(m))
matrix_query("G19_norm", "SELECT round(sqrt(sum(v * v)), 4) + 0.0 AS v FROM x", lambda m, x: linear.norm(x))
matrix_query("G20_square_norm", "SELECT round(sum(v * v), 7) + 0.0 AS v FROM x", lambda m, x: linear.square_norm(x), 7)
matrix_query("X08_sub_array_long", "SELECT j, round(v, 4) + 0.0 AS v FROM m WHERE i = 7", lambda m, x: arrays.sub_array(m, "i", 7))
#: The same matrix with an imaginary part, and the vector with one.
_COMPLEX = ", c AS (SELECT i, j, v AS re, round(v * (i - j), 3) AS im FROM m), y AS (SELECT i, v AS re, round(-v * i, 3) AS im FROM x)"


def complex_query(name: str, sql: str, f: Callable[[DataFrame, DataFrame], DataFrame], digits: int = 4) -> None:
    def both(m, x):
        im = lambda df, v: df.select(*[c for c in df.columns if c != "v"], F.col("v").alias("re"), F.round(v, 3).alias("im"))
        return f(im(m, F.col("v") * (F.col("i") - F.col("j"))), im(x, -F.col("v") * F.col("i")))

    matrix_query(name, _COMPLEX + " " + sql, both, digits)


#: Rounded sums of the products of two complex factors a and b.
_RE_IM = "round(sum(a.re * b.re - a.im * b.im), 7) + 0.0 AS re, round(sum(a.re * b.im + a.im * b.re), 7) + 0.0 AS im"


complex_query("L05_scale_complex", "SELECT i, j, round(2.5 * re + 0.5 * im, 5) + 0.0 AS re, round(2.5 * im - 0.5 * re, 5) + 0.0 AS im FROM c", lambda m, x: linear.product(m, 2.5 - 0.5j), 5)
complex_query("L06_matmul_complex", f"SELECT a.i, b.j, {_RE_IM} FROM c a JOIN c b ON a.j = b.i GROUP BY ALL", lambda m, x: linear.product(m, m), 7)
complex_query("L08_matvec_complex", f"SELECT a.i, {_RE_IM} FROM c a JOIN y b ON a.j = b.i GROUP BY ALL", lambda m, x: linear.product(m, x), 7)
complex_query("L09_add_scalar_complex", "SELECT i, j, round(sum(re), 4) + 0.0 AS re, round(sum(im), 4) + 0.0 AS im FROM (SELECT * FROM c UNION ALL SELECT i, i, 1.5, -2.0 FROM range(25) t(i)) GROUP BY ALL", lambda m, x: linear.add_scalar(m, 1.5 - 2j, 25))
complex_query("L11_matrix_power_complex", "SELECT i, j, round(sum(are * bre - aim * bim) / 1e6, 4) + 0.0 AS re, round(sum(are * bim + aim * bre) / 1e6, 4) + 0.0 AS im FROM (SELECT p.i, b.j, p.re AS are, p.im AS aim, b.re AS bre, b.im AS bim FROM (SELECT a.i, b.j, sum(a.re * b.re - a.im * b.im) AS re, sum(a.re * b.im + a.im * b.re) AS im FROM c a JOIN c b ON a.j = b.i GROUP BY ALL) p JOIN c b ON p.j = b.i) GROUP BY ALL", lambda m, x: linear.scale(linear.matrix_power(m, 3, 25), 1e-6))
complex_query("L02_dot_complex", "SELECT round(sum(re * re + im * im), 7) + 0.0 AS re, 0.0::DOUBLE AS im FROM y", lambda m, x: linear.product(x, x), 7)
complex_query("G16_trace_complex", "SELECT round(sum(re), 4) + 0.0 AS re, round(sum(im), 4) + 0.0 AS im FROM c WHERE i = j", lambda m, x: linear.trace(m))
complex_query("G18_G19_norms_complex", "SELECT round((SELECT sqrt(sum(re * re + im * im)) FROM c), 4) + 0.0 AS v UNION ALL SELECT round((SELECT sqrt(sum(re * re + im * im)) FROM y), 4) + 0.0", lambda m, x: linear.frobenius(m).unionByName(linear.norm(x)))
complex_query("G20_square_norm_complex", "SELECT round(sum(re * re + im * im), 7) + 0.0 AS v FROM y", lambda m, x: linear.square_norm(x), 7)
complex_query("L12_determinants_complex", ", d AS (SELECT i // 2 AS k, coalesce(max(re) FILTER (i % 2 = 0 AND j % 2 = 0), 0) AS pr, coalesce(max(im) FILTER (i % 2 = 0 AND j % 2 = 0), 0) AS pi, coalesce(max(re) FILTER (i % 2 = 0 AND j % 2 = 1), 0) AS qr, coalesce(max(im) FILTER (i % 2 = 0 AND j % 2 = 1), 0) AS qi, coalesce(max(re) FILTER (i % 2 = 1 AND j % 2 = 0), 0) AS sr, coalesce(max(im) FILTER (i % 2 = 1 AND j % 2 = 0), 0) AS si, coalesce(max(re) FILTER (i % 2 = 1 AND j % 2 = 1), 0) AS tr, coalesce(max(im) FILTER (i % 2 = 1 AND j % 2 = 1), 0) AS ti FROM c WHERE i // 2 = j // 2 AND i < 24 GROUP BY ALL) SELECT k, round(pr * tr - pi * ti - qr * sr + qi * si, 4) + 0.0 AS re, round(pr * ti + pi * tr - qr * si - qi * sr, 4) + 0.0 AS im FROM d", lambda m, x: linear.determinants(arrays.blockify(m, {"i": 2, "j": 2}).where("bi = bj and bi < 12").withColumnRenamed("bi", "k"), ["k"], 2))
matrix_query("G06_sd_dimension", "SELECT i, round(stddev_pop(v), 4) + 0.0 AS sd FROM m GROUP BY i", lambda m, x: statistics.deviation(m, "v", ["i"]))
matrix_query("G11_extremes_long", "SELECT round(max(v), 4) + 0.0 AS maximum, first(i ORDER BY v DESC, i, j) AS max_i, first(j ORDER BY v DESC, i, j) AS max_j, round(min(v), 4) + 0.0 AS minimum, first(i ORDER BY v, i, j) AS min_i, first(j ORDER BY v, i, j) AS min_j FROM m", lambda m, x: statistics.extremes(m, ["i", "j"], "v"))


@query("L06_gram", "WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, round(sum(a.v * b.v), 4) + 0.0 AS v FROM e a JOIN e b USING (vec_id) GROUP BY ALL")
def _gram(spark, sf_dir):
    return rounded(linear.gram(embeddings(spark, sf_dir), "v"))


@query("L12_determinants", "WITH x AS (SELECT l_suppkey, l_linenumber % 2 AS i, l_partkey % 2 AS j, round(avg(l_quantity), 2) AS v FROM lineitem GROUP BY ALL), p AS (SELECT l_suppkey, coalesce(max(v) FILTER (i = 0 AND j = 0), 0) AS a, coalesce(max(v) FILTER (i = 0 AND j = 1), 0) AS b, coalesce(max(v) FILTER (i = 1 AND j = 0), 0) AS c, coalesce(max(v) FILTER (i = 1 AND j = 1), 0) AS d FROM x GROUP BY l_suppkey) SELECT l_suppkey, round(a * d - b * c, 4) + 0.0 AS det FROM p")
def _determinants(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_linenumber") % 2).alias("i"), (F.col("l_partkey") % 2).cast("int").alias("j")).agg(F.round(F.avg("l_quantity"), 2).alias("v"))
    return rounded(linear.determinants(cells, ["l_suppkey"], 2))


# Statistics of long tables


@query("G05_sd", "SELECT l_returnflag, round(stddev_pop(l_extendedprice), 4) + 0.0 AS sd FROM lineitem GROUP BY ALL")
def _sd(spark, sf_dir):
    return rounded(statistics.deviation(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@query("G07_mean_product", "SELECT l_returnflag, round(avg(l_quantity * l_discount), 6) + 0.0 AS corr FROM lineitem GROUP BY ALL")
def _mean_product(spark, sf_dir):
    return rounded(statistics.mean_product(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"]), 6)


@query("G02_G03_interval", "SELECT l_returnflag, round(sum(l_quantity), 4) + 0.0 AS sum, round(avg(l_quantity), 6) + 0.0 AS mean FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 GROUP BY ALL")
def _interval(spark, sf_dir):
    out = statistics.total(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"], "l_linenumber", 2, 4)
    return out.select("l_returnflag", r("sum", 4).alias("sum"), r("mean", 6).alias("mean"))


@query("G10_weighted_median", "WITH w AS (SELECT p_size AS i, count(*) AS n FROM part GROUP BY ALL), c AS (SELECT i, sum(n) OVER (ORDER BY i) AS s, sum(n) OVER () AS t FROM w) SELECT coalesce(max(i) FILTER (2 * s <= t), 0) AS median FROM c")
def _median(spark, sf_dir):
    return statistics.weighted_median(table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("i")).agg(F.count("*").alias("n")), "i", "n")


@query("G10_weighted_median_keys", "WITH w AS (SELECT p_brand, p_size AS i, count(*) AS n FROM part GROUP BY ALL), c AS (SELECT p_brand, i, sum(n) OVER (PARTITION BY p_brand ORDER BY i) AS s, sum(n) OVER (PARTITION BY p_brand) AS t FROM w) SELECT p_brand, coalesce(max(i) FILTER (2 * s <= t), 0) AS median FROM c GROUP BY p_brand")
def _median_keys(spark, sf_dir):
    return statistics.weighted_median(table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("i")).agg(F.count("*").alias("n")), "i", "n", ["p_brand"])


_HIST = "least(19, floor((l_extendedprice - 0.0) / 100000.0 * 20)::INTEGER)"


@query("G15_histogram", f"SELECT c::INTEGER AS class, coalesce(n, 0) AS count FROM range(20) t(c) LEFT JOIN (SELECT {_HIST} AS k, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 100000 GROUP BY 1) ON k = c")
def _histogram(spark, sf_dir):
    return statistics.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20, 0, 100_000)


@query("G14_classes", "SELECT least(9, floor((p_retailprice - 900.0) / 1200.0 * 10)::INTEGER) AS class, p_partkey FROM part WHERE p_retailprice BETWEEN 900 AND 2100")
def _classes(spark, sf_dir):
    return statistics.class_members(table(spark, sf_dir, "part"), "p_partkey", "p_retailprice", 10, 900, 2100)


@query("O01_O02_argsort_long", "SELECT o_orderkey, round(o_totalprice, 4) + 0.0 AS o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders")
def _argsort(spark, sf_dir):
    return rounded(statistics.argsort(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice"))


@query("G01_running_sum", "SELECT o_orderkey, (sum(o_custkey) OVER (ORDER BY o_orderkey))::BIGINT AS running FROM orders")
def _running(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return running_sum(rows, "o_orderkey", "o_custkey", width=4096).select("o_orderkey", "running")


# Observables

STEP = "((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INTEGER"
CUBE = f"(SELECT {STEP} AS step, o_orderpriority AS observable, 0 AS idx, sum(o_totalprice / 1013) AS s, sum((o_totalprice / 1013) ** 2) AS q, count(*)::DOUBLE AS c FROM orders GROUP BY ALL)"


def order_cube(spark, sf_dir):
    step = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    return observables.cube(table(spark, sf_dir, "orders"), step, F.col("o_orderpriority"), F.col("o_totalprice") / 1013)


def cube_query(name: str, sql: str, digits: int = 6):
    def register(f):
        return query(name, f"WITH x AS {CUBE} {sql}")(lambda spark, sf_dir: rounded(f(order_cube(spark, sf_dir)), digits))

    return register


_JACK = "t AS (SELECT observable, idx, sum(s) AS ss, sum(c) AS cc, count(*) AS n FROM x GROUP BY ALL), j AS (SELECT x.step, x.observable, x.idx, (ss - s) / (cc - c) AS theta, ss / cc AS mean, n FROM x JOIN t USING (observable, idx))"


@cube_query("G08_G09_R03_observables", f", {_JACK}, e AS (SELECT observable, idx, sqrt((max(n) - 1) / max(n) * sum((theta - mean) ** 2)) AS jackknife FROM j GROUP BY ALL) SELECT observable, idx, round(sum(s) / sum(c), 6) + 0.0 AS mean, round(sqrt((sum(q) - sum(s) ** 2 / sum(c)) / (sum(c) - 1)), 6) + 0.0 AS sd, count(*) AS steps, round(max(jackknife), 6) + 0.0 AS jackknife FROM x JOIN e USING (observable, idx) GROUP BY ALL")
def flagship(cells):
    return observables.report(cells)


cube_query("G09_standard_deviation", "SELECT observable, idx, round(sum(s) / sum(c), 6) + 0.0 AS mean, round(sqrt((sum(q) - sum(s) ** 2 / sum(c)) / (sum(c) - 1)), 6) + 0.0 AS sd, count(*) AS steps FROM x GROUP BY ALL")(observables.summary)
cube_query("R03_jackknife_error", f", {_JACK} SELECT observable, idx, round(sqrt((max(n) - 1) / max(n) * sum((theta - mean) ** 2)), 6) + 0.0 AS jackknife FROM j GROUP BY ALL")(observables.jackknife_error)
cube_query("S21_cube", "SELECT step, observable, idx, round(s, 6) + 0.0 AS s, round(q, 6) + 0.0 AS q, c FROM x")(lambda cells: cells)
cube_query("G08_mean_interval", "SELECT observable, idx, round(sum(s) / sum(c), 6) + 0.0 AS mean FROM x WHERE step BETWEEN 10 AND 30 GROUP BY ALL")(lambda cells: observables.summary(cells, 10, 30).select("observable", "idx", "mean"))
cube_query("R02_jackknife_means", f", {_JACK} SELECT step, observable, idx, round(theta, 6) + 0.0 AS theta, round(mean, 6) + 0.0 AS mean, n FROM j")(observables.jackknife_means)
cube_query("R01_binning", "SELECT ((step + 1) * 7 - 1) // (SELECT max(step) + 1 FROM x) AS step, observable, idx, round(sum(s) / sum(c), 6) + 0.0 AS s, round((sum(s) / sum(c)) ** 2, 6) + 0.0 AS q, 1.0::DOUBLE AS c FROM x GROUP BY ALL")(lambda cells: observables.binning(cells, 7))
_P = observables.PRIME
_STEPS = "(SELECT max(step) + 1 FROM x)"
_BOOT = f", h0 AS (SELECT r, d, (r * 1000003 + d * 10007 + 17) % {_P} AS h FROM range(40) a(r), (SELECT unnest(range({_STEPS})) AS d) b)"
for _k, _c in enumerate((11, 23, 37)):
    _BOOT += f", h{_k + 1} AS (SELECT r, d, (h * h % {_P} + h * 48271 + {_c}) % {_P} AS h FROM h{_k})"
_BOOT += (
    f", plan AS (SELECT r AS sample, d AS draw, CASE WHEN r = 0 THEN d ELSE h % {_STEPS} END AS step FROM h3), th AS (SELECT sample, observable, idx, sum(s) / sum(c) AS theta FROM plan JOIN x USING (step) GROUP BY ALL)"
)
def drawn(cells: DataFrame) -> DataFrame:
    """40 samples of as many steps as there are."""
    steps = (cells.agg(F.max("step")).first()[0] or 0) + 1
    return observables.bootstrap(cells, 40, steps, steps)


cube_query("R04_bootstrap", _BOOT.split(", th AS")[0] + " SELECT sample::INTEGER AS sample, draw::INTEGER AS draw, step::INTEGER AS step, observable, idx, round(s, 6) + 0.0 AS s, round(q, 6) + 0.0 AS q, c FROM plan JOIN x USING (step)")(lambda cells: drawn(cells).select("sample", "draw", "step", "observable", "idx", "s", "q", "c"))
cube_query("R05_sample_means", _BOOT + " SELECT sample::INTEGER AS sample, observable, idx, round(theta, 6) + 0.0 AS theta FROM th")(lambda cells: observables.sample_means(drawn(cells)))
cube_query("R06_bootstrap_error", _BOOT + " SELECT observable, idx, round(stddev_samp(theta), 6) + 0.0 AS error FROM th GROUP BY ALL")(lambda cells: observables.sample_error(observables.sample_means(drawn(cells))))
cube_query("R06_error_about_mean", _BOOT + ", m AS (SELECT observable, idx, sum(s) / sum(c) AS mean FROM x GROUP BY ALL) SELECT observable, idx, round(sqrt(sum((theta - mean) ** 2) / (count(*) - 1)), 6) + 0.0 AS error FROM th JOIN m USING (observable, idx) GROUP BY ALL")(lambda cells: observables.sample_error(observables.sample_means(drawn(cells)), observables.summary(cells)))


@query("S21_empty_cube", "SELECT a::INTEGER AS step, b::INTEGER AS observable, i::INTEGER AS idx, 0.0::DOUBLE AS s, 0.0::DOUBLE AS q, 0.0::DOUBLE AS c FROM range(20) x(a), range(3) y(b), range(2) z(i)")
def _empty_cube(spark, sf_dir):
    return observables.empty_cube(spark, 20, 3, 2)


@query("G09_uniform_moments", "WITH u AS (SELECT event_id // 10 AS step, event_id % 3 AS observable, ((event_id * 7919 + 104729) % 10007) / 10007.0::DOUBLE AS v FROM events), x AS (SELECT step, observable, sum(v) AS s, sum(v * v) AS q, count(*) AS c FROM u GROUP BY ALL) SELECT observable, 0 AS idx, round(sum(s) / sum(c), 6) + 0.0 AS mean, round(sqrt((sum(q) - sum(s) ** 2 / sum(c)) / (sum(c) - 1)), 6) + 0.0 AS sd, count(*) AS steps FROM x GROUP BY ALL")
def _uniform(spark, sf_dir):
    v = ((F.col("event_id") * 7919 + 104729) % 10007) / 10007.0
    return rounded(observables.summary(observables.cube(table(spark, sf_dir, "events"), F.floor(F.col("event_id") / 10), F.col("event_id") % 3, v)), 6)


@query("streaming_moments", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS observable, round(sum(value), 4) + 0.0 AS s, round(sum(value * value), 5) + 0.0 AS q, count(value)::DOUBLE AS c FROM events WHERE value IS NOT NULL GROUP BY ALL")
def _windows(spark, sf_dir):
    out = windowed_moments(table(spark, sf_dir, "events"), "ts", F.col("event_type"), F.col("value"), "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "observable", r("s", 4).alias("s"), r("q", 5).alias("q"), "c")


# Series: events an hour from the first of the month, and revenue a day.

#: From the first hour that has an event to the last one; n: how many.
SERIES = (
    "e AS (SELECT date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS k, count(*) AS n FROM events GROUP BY 1), g AS (SELECT min(k) AS low, max(k) - min(k) + 1 AS n FROM e), "
    "x AS (SELECT h AS i, coalesce(e.n, 0)::DOUBLE AS v FROM (SELECT unnest(range((SELECT n FROM g))) AS h) t LEFT JOIN e ON e.k = h + (SELECT low FROM g)), ps AS (SELECT i AS p FROM x)"
)
N = "(SELECT n FROM g)"


def series(spark, sf_dir) -> tuple[DataFrame, int]:
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    counts = table(spark, sf_dir, "events").groupBy(hour.alias("k")).agg(F.count("*").cast("double").alias("n"))
    facts = counts.agg(F.min("k").alias("low"), F.max("k").alias("high")).first()
    low, n = (0, 0) if facts["low"] is None else (facts["low"], facts["high"] - facts["low"] + 1)
    counts = counts.select((F.col("k") - low).alias("i"), "n")
    return spark.range(n).select(F.col("id").alias("i")).join(counts, "i", "left").select("i", F.coalesce("n", F.lit(0.0)).alias("v")), n


def series_query(name: str, sql: str, digits: int = 4):
    def register(f):
        return query(name, f"WITH {SERIES} {sql}")(lambda spark, sf_dir: rounded(f(*series(spark, sf_dir)), digits))

    return register


_AC = "p AS (SELECT b.i - a.i AS t, a.v * b.v AS p FROM x a JOIN x b ON b.i BETWEEN a.i AND a.i + 48), z AS (SELECT avg(v * v) AS z FROM x)"
series_query("F01_F02_autocorrelation", f", {_AC} SELECT t::INTEGER AS t, round(avg(p) / max(z), 6) + 0.0 AS ac, round(stddev_pop(p) / sqrt(count(*)) / max(z), 6) + 0.0 AS sd FROM p, z GROUP BY t", 6)(lambda x, n: signal.autocorrelation(x, 48))
series_query("F01_autocorrelation_keys", ", d AS (SELECT i // 24 AS day, i % 24 AS i, v FROM x), z AS (SELECT day, avg(v * v) AS z FROM d GROUP BY day) SELECT a.day, (b.i - a.i)::INTEGER AS t, round(avg(a.v * b.v) / max(z), 6) + 0.0 AS ac FROM d a JOIN d b ON b.day = a.day AND b.i BETWEEN a.i AND a.i + 5 JOIN z ON z.day = a.day GROUP BY a.day, t", 6)(lambda x, n: signal.autocorrelation(days(x), 5, keys=["day"]).select("day", "t", "ac"))
series_query("F01_autocorrelation_periodic", f"SELECT t::INTEGER AS t, round(avg(a.v * b.v), 6) + 0.0 AS ac FROM x a CROSS JOIN range(49) g(t) JOIN x b ON b.i = (a.i + t) % {N} GROUP BY t", 6)(lambda x, n: signal.autocorrelation(x, 48, n, periodic=True, normalise=False).select("t", "ac"))
_DFT = "round(sum(v * cos(w)), 4) + 0.0 AS re, round(-sum(v * sin(w)), 4) + 0.0 AS im"
_WHOLE = f"SELECT p::INTEGER AS p, {_DFT} FROM (SELECT p, v, 2 * pi() * ((i * p) % {N}) / {N} AS w FROM x, ps) GROUP BY p"
_DAILY = f"SELECT i // 24 AS day, p::INTEGER AS p, {_DFT} FROM (SELECT i, p, v, 2 * pi() * (((i % 24) * p) % 24) / 24 AS w FROM x, range(24) h(p)) GROUP BY day, p"


def days(x: DataFrame) -> DataFrame:
    return arrays.blockify(x, {"i": 24}).withColumnRenamed("bi", "day")


series_query("F03_momentum", f"SELECT round(sum(v * cos(w)), 4) + 0.0 AS re, round(-sum(v * sin(w)), 4) + 0.0 AS im FROM (SELECT v, 2 * pi() * i * 2.5 / {N} AS w FROM x)")(lambda x, n: signal.momentum(x, 2.5, n))
series_query("F03_momentum_keys", "SELECT i // 24 AS day, round(sum(v * cos(w)), 4) + 0.0 AS re, round(-sum(v * sin(w)), 4) + 0.0 AS im FROM (SELECT i, v, 2 * pi() * (i % 24) * 1.5 / 24 AS w FROM x) GROUP BY day")(lambda x, n: signal.momentum(days(x), 1.5, 24, keys=["day"]))
series_query("F04_dft", _WHOLE)(lambda x, n: signal.transform(x, n))
series_query("F04_dft_keys", _DAILY)(lambda x, n: signal.transform(days(x), 24, keys=["day"]))
series_query("F04_dft_scaled", f"SELECT p::INTEGER AS p, {_DFT} FROM (SELECT p, v, 2 * pi() * ((i * p * 2) % {N}) / {N} AS w FROM x, ps WHERE p < ceil({N} / 2.0)) GROUP BY p")(lambda x, n: signal.transform(x, n, scale=2))
series_query("F05_fft", _WHOLE)(lambda x, n: signal.fft(x.withColumn("k", F.lit(0)), ["k"]).drop("k"))
series_query("F05_fft_keys", _DAILY)(lambda x, n: signal.fft(days(x), ["day"]))
series_query("F05_two_stage_fft", _WHOLE)(lambda x, n: signal.two_stage_fft(x, n))
series_query("F05_chirp_fft", _WHOLE)(lambda x, n: signal.chirp_fft(x, n))
series_query("F06_power_of_two", "SELECT i, i > 0 AND (i & (i - 1)) = 0 AS two FROM x")(lambda x, n: x.select("i", signal.is_power_of_two(F.col("i")).alias("two")))
series_query("F07_inverse", f", s AS (SELECT p, sum(v * cos(w)) AS re, -sum(v * sin(w)) AS im FROM (SELECT p, v, 2 * pi() * ((i * p) % {N}) / {N} AS w FROM x, ps) GROUP BY p) SELECT round(sum(re * cos(2 * pi() * p * 5.0 / {N}) - im * sin(2 * pi() * p * 5.0 / {N})) / {N}, 4) + 0.0 AS re FROM s")(lambda x, n: signal.inverse(signal.transform(x, n), 5.0, n).select("re"))
series_query("F07_inverse_keys", "SELECT i // 24 AS day, round(v, 4) + 0.0 AS re FROM x WHERE i % 24 = 5")(lambda x, n: signal.inverse(signal.transform(days(x), 24, keys=["day"]), 5.0, 24, keys=["day"]).select("day", "re"))
series_query("C01_forward_difference", "SELECT a.i, a.v, round((b.v - a.v) / 0.5, 4) + 0.0 AS d FROM x a LEFT JOIN x b ON b.i = a.i + 1")(lambda x, n: calculus.forward_difference(x, 0.5))
series_query("C02_central_difference", "SELECT a.i, a.v, round((b.v - c.v) / 1.0, 4) + 0.0 AS d FROM x a LEFT JOIN x b ON b.i = a.i + 1 LEFT JOIN x c ON c.i = a.i - 1")(lambda x, n: calculus.central_difference(x, 0.5))
_EVEN = f"({N} - 1 - ({N} - 1) % 2)"  # intervals under Simpson's rule; the one that may be left is a trapezium
_SIMPSON = f"CASE WHEN i > {_EVEN} THEN 0 WHEN i IN (0, {_EVEN}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 3.0::DOUBLE + CASE WHEN {_EVEN} < {N} - 1 AND i >= {_EVEN} THEN 0.5 ELSE 0 END"
series_query("C03_C04_series_integral", f"SELECT 'trapezium' AS rule, round(sum(CASE WHEN i IN (0, {N} - 1) THEN 0.5 ELSE 1 END * v) * 0.25, 4) + 0.0 AS integral FROM x UNION ALL SELECT 'simpson', round(sum(({_SIMPSON}) * v) * 0.25, 4) + 0.0 FROM x")(lambda x, n: calculus.integrate_series(x, 0.25, n - 1).select(F.lit("trapezium").alias("rule"), "integral").unionByName(calculus.integrate_series(x, 0.25, n - 1, "simpson").select(F.lit("simpson").alias("rule"), "integral")))
series_query("X10_rotate_long", f"SELECT (i - 10 + {N}) % {N} AS i, v FROM x")(lambda x, n: arrays.rotate(x, 10, n))
series_query("X10_shift_long", "SELECT i - 10 AS i, v FROM x WHERE i >= 10 UNION ALL SELECT i + 7, v FROM x")(lambda x, n: arrays.shift(x, -10).unionByName(arrays.shift(x, 7)))
series_query("X09_interval_long", "SELECT i - 100 AS i, v FROM x WHERE i BETWEEN 100 AND 200")(lambda x, n: arrays.interval(x, "i", 100, 200))
series_query("X11_X12_blockify_long", "SELECT i // 24 AS block, i % 24 AS j, i, v FROM x")(lambda x, n: (lambda b: arrays.deblockify(b.withColumns({"block": F.col("bi"), "j": F.col("i")}), {"i": 24}))(arrays.blockify(x, {"i": 24})))


@query("C02_derivative_of_expression", "SELECT i, round(2 * (i / 50.0::DOUBLE), 6) + 0.0 AS d FROM range(100) t(i)")
def _derivative(spark, sf_dir):
    return spark.range(100).select(F.col("id").alias("i"), r(calculus.derivative(lambda x: x * x, F.col("id") / 50.0, 0.125)).alias("d"))


@query("C03_trapezium", "SELECT 0.33335::DOUBLE AS integral")
def _trapezium(spark, sf_dir):
    return rounded(calculus.integrate(spark, lambda x: x * x, 0, 1, 100), 9)


@query("C04_simpson", "SELECT round(1.0::DOUBLE / 3, 9) AS integral")
def _simpson(spark, sf_dir):
    return rounded(calculus.integrate(spark, lambda x: x * x, 0, 1, 99, "simpson"), 9)


# Fits: of known curves over real points, so that parameters are known; and of a histogram.


def _curve(f: Callable[[Column, Column], Column]) -> Query:
    def points(spark, sf_dir):
        n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
        x = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(60))))
        return x.select("k", ((F.col("i") - 30) / 10.0).alias("x"), f(F.col("k").cast("double"), (F.col("i") - 30) / 10.0).alias("y"), F.lit(0.1).alias("sigma"))

    return points


def _fitted(name: str, sql: str, f, model: fit.Model) -> None:
    points = _curve(f)
    QUERIES[name] = lambda spark, sf_dir: fit.fit(points(spark, sf_dir), ["k"], model).select("k", rv(P.absolute("parameters") if isinstance(model, fit.Lorentzians) else F.col("parameters"), 4).alias("parameters"), r("chi2", 4).alias("chi2"))
    ORACLE[name] = f"SELECT n_nationkey AS k, {sql} AS parameters, 0.0::DOUBLE AS chi2 FROM nation"


_fitted("C05_C08_C09_C11_fit_gaussian", "[round(1 + n_nationkey / 10.0::DOUBLE, 4), -0.5::DOUBLE]", lambda k, x: (1 + k / 10) * F.exp(-0.5 * x * x), fit.SingleGaussian())
_fitted("C10_fit_exponentials", "[round(2 + n_nationkey / 10.0::DOUBLE, 4), -0.4::DOUBLE]", lambda k, x: (2 + k / 10) * F.exp(-0.4 * x), fit.Exponentials(1, start=[1.0, -0.1]))
_fitted("C12_C13_fit_gaussians", "[round(2 + n_nationkey / 20.0::DOUBLE, 4), 1.0::DOUBLE, 0.6::DOUBLE]", lambda k, x: (2 + k / 20) * F.exp(-0.5 * F.pow((x + 1) / 0.6, 2)) + F.exp(-0.5 * F.pow((x - 1.5) / 0.6, 2)), fit.Gaussians([1.5, 1.5], [0.8], [-1.0, 1.5]))
_fitted("C12_C14_fit_lorentzians", "[round(2 + n_nationkey / 20.0::DOUBLE, 4), 0.5::DOUBLE, 0.25::DOUBLE]", lambda k, x: (2 + k / 20) / (math.pi * 0.5 * (1 + F.pow((x - 0.25) / 0.5, 2))), fit.Lorentzians([1.0], [1.0], [0.0], (False, False, False)))


class Line(fit.Model):
    """A model of one's own."""

    def parameters(self):
        return np.zeros(2)

    def value(self, x, p):
        return p[0] + p[1] * x


@query("C06_U04_fit_custom_model", "SELECT n_nationkey AS k, [n_nationkey::DOUBLE, 3.0::DOUBLE] AS parameters FROM nation")
def _custom(spark, sf_dir):
    points = _curve(lambda k, x: k + 3 * x)(spark, sf_dir)
    return fit.fit(points, ["k"], Line()).select("k", rv(F.col("parameters"), 4).alias("parameters"))


@query("C05_fit_without_x", "SELECT n_nationkey AS k, [n_nationkey::DOUBLE, 3.0::DOUBLE] AS parameters FROM nation")
def _without_x(spark, sf_dir):
    """Points that only an order tells apart count as 0, 1, 2, ..."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    points = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(60)))).repartition(8)
    points = points.select("k", (F.col("i") * 10 + 5).alias("at"), (F.col("k") + 3.0 * F.col("i")).alias("y"))
    return fit.fit(points, ["k"], Line(), x=None, sigma=None, order="at").select("k", rv(F.col("parameters"), 4).alias("parameters"))


@query("C09_fit_prices", "SELECT o_orderpriority AS k, [round(regr_intercept(y, x), 3) + 0.0, round(regr_slope(y, x), 3) + 0.0] AS parameters FROM (SELECT o_orderpriority, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::DOUBLE AS x, avg(o_totalprice) / 1000 AS y FROM orders GROUP BY ALL) GROUP BY ALL")
def _fit_prices(spark, sf_dir):
    """Measured data: a line through the mean price of each month, which has a closed form too."""
    step = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("double")
    points = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), step.alias("x")).agg((F.avg("o_totalprice") / 1000).alias("y"))
    return fit.fit(points, ["k"], Line(), sigma=None).select("k", rv(F.col("parameters"), 3).alias("parameters"))


@query("C09_fit_histogram")
def _fit_histogram(spark, sf_dir):
    h = statistics.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 40, 0, 500_000)
    points = h.select(F.lit(0).alias("k"), (F.col("class") + 0.5).alias("x"), F.col("count").cast("double").alias("y"), F.sqrt(F.col("count") + 1.0).alias("sigma"))
    return fit.fit(points, ["k"], fit.Gaussians([100.0], [10.0], [12.0], (False, False, False)))


@query("C15_remove_excited_states", "SELECT r::INTEGER AS replicate, i / 4.0::DOUBLE AS t, round(2 * exp(-0.5 * (i / 4.0::DOUBLE)) + (((i / 4.0::DOUBLE * 7919 + r * 104729)::DOUBLE // 1)::BIGINT % 101 - ((i / 4.0::DOUBLE * 7919) // 1)::BIGINT % 101) / 1e9, 3) + 0.0 AS v FROM range(40) a(i), range(8) b(r)")
def _excited(spark, sf_dir):
    base = spark.range(40).select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("replicate"), (F.col("id") / 4.0).alias("t"))
    noise = ((F.col("t") * 7919 + F.col("replicate") * 104729).cast("long") % 101 - 50) / 1e9
    out = fit.remove_excited_states(base.select("replicate", "t", (2 * F.exp(-0.5 * F.col("t")) + noise).alias("v")), 1, 0.5, 9.0, start=[1.0, -0.2])
    return rounded(out.select("replicate", "t", "v"), 3)


# Text: files are written and read back.


def _scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors share: below the cluster's checkpoint folder, or the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/obsframe-text/{uuid.uuid4().hex}"


_INT_MATRIX = "SELECT c_nationkey AS i, (c_custkey % 25)::INTEGER AS j, count(*)::DOUBLE AS v FROM customer GROUP BY ALL"
_FULL = f"SELECT a.i::INTEGER AS i, b.j::INTEGER AS j, coalesce(v, 0)::DOUBLE AS v FROM (SELECT DISTINCT i FROM m) a CROSS JOIN (SELECT unnest(range((SELECT max(j) + 1 FROM m))) AS j) b LEFT JOIN m ON m.i = a.i AND m.j = b.j"


def _counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("i"), (F.col("c_custkey") % 25).cast("int").alias("j")).agg(F.count("*").cast("double").alias("v"))


@query("S01_S02_S03_S06_text_matrix", f"WITH m AS ({_INT_MATRIX}) SELECT row_number() OVER (PARTITION BY j ORDER BY i)::INTEGER - 1 AS i, j, v FROM ({_FULL})")
def _text_matrix(spark, sf_dir):
    path = _scratch(spark)
    text.write(_counts(spark, sf_dir), path)
    return text.read_matrix(spark, path)


@query("S04_text_vector", "SELECT (row_number() OVER (ORDER BY i) - 1)::INTEGER AS i, 0 AS j, i::DOUBLE AS v FROM (SELECT s_nationkey AS i FROM supplier GROUP BY 1) UNION ALL SELECT (row_number() OVER (ORDER BY i) - 1)::INTEGER, 1, n FROM (SELECT s_nationkey AS i, count(*)::DOUBLE AS n FROM supplier GROUP BY 1)")
def _text_vector(spark, sf_dir):
    path = _scratch(spark)
    v = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("i")).agg(F.count("*").cast("double").alias("v"))
    text.write(v, path, with_index=True)
    return text.read_matrix(spark, path)


@query("S05_text_tensor", _INT_MATRIX)
def _text_tensor(spark, sf_dir):
    path = _scratch(spark)
    text.write_tensor(_counts(spark, sf_dir), path, ["i", "j"])
    return text.read_tensor(spark, path, ["i", "j"])


@query("S07_S08_text_cube", "SELECT ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INTEGER AS step, substr(o_orderpriority, 1, 1)::INTEGER - 1 AS observable, 0 AS idx, sum(o_custkey)::DOUBLE AS s, sum(o_custkey * o_custkey)::DOUBLE AS q, count(*)::DOUBLE AS c FROM orders GROUP BY ALL")
def _text_cube(spark, sf_dir):
    path = _scratch(spark)
    step = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    cells = observables.cube(table(spark, sf_dir, "orders"), step, F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.col("o_custkey"))
    steps, priorities = cells.agg(F.max("step") + 1, F.max("observable") + 1).first()
    text.export_cube(cells, path, steps, priorities, [1])
    return text.import_cube(spark, path).where("c > 0")


@query("S02_parse_number", "SELECT o_orderkey, o_orderkey::DOUBLE AS a, (o_orderkey // 2)::BIGINT AS b, 0.0::DOUBLE AS c, -o_orderkey * 0.5::DOUBLE AS d FROM orders")
def _parse(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    half = (F.col("o_orderkey") * -0.5).cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.parse_number(F.concat(key, F.lit("x3"))).alias("a"), text.parse_number(F.concat(F.lit(" "), F.floor(F.col("o_orderkey") / 2).cast("string"), F.lit(".9")), "long").alias("b"),
        text.parse_number(F.concat(F.lit("x"), key)).alias("c"), text.parse_number(F.concat(half, F.lit(" 7"))).alias("d"),
    )


@query("S20_random_pi", "SELECT count(*) AS n, true AS inside, true AS near_pi, true AS near_sd FROM lineitem")
def _pi(spark, sf_dir):
    """What any generator of uniform numbers must give: their range, and pi and the deviation within six standard errors."""
    n = table(spark, sf_dir, "lineitem").select(P.random(1.0, 1).alias("x"), P.random(1.0, 2).alias("y"))
    pi = 4 * F.avg((F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1).cast("double"))
    inside = (F.min("x") >= 0) & (F.max("x") < 1) & (F.min("y") >= 0) & (F.max("y") < 1)
    error = F.lit(6.0) / F.sqrt(F.count("*"))
    return n.agg(F.count("*").alias("n"), inside.alias("inside"), (F.abs(pi - math.pi) < 1.65 * error).alias("near_pi"), (F.abs(F.stddev_pop("x") - 1 / math.sqrt(12)) < 0.3 * error).alias("near_sd"))


@query("G1_G2_shell", "SELECT 10.3::DOUBLE AS a, 3.0::DOUBLE AS b")
def _shell(spark, sf_dir):
    from .shell import evaluate

    return evaluate(spark, "cast(3.3 + 7 as double) AS a, sqrt(9) AS b")
