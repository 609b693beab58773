"""Long tables: golden values, properties, and agreement with numpy and with the packed form."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe import plans
from obsframe.functions import packed as P
from obsframe.catalogue import Line
from obsframe.operators import arrays, calculus, fit, linear, observables, order, signal, statistics
from obsframe.shell import evaluate, main, script
from obsframe.sources import text
from obsframe.streaming.moments import windowed_moments


def matrix(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row) if v], "i int, j int, v double")


def vector(spark, v):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")


def dense(df, *shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[c] for c in ("i", "j") if c in df.columns)] = r["v"]
    return out


def test_linear_algebra(spark):
    m, v = matrix(spark, [[1, 2], [3, 4]]), vector(spark, [10, 20])
    assert dense(linear.product(m, m), 2, 2).tolist() == [[7, 10], [15, 22]]
    assert dense(linear.product(m, v), 2).tolist() == [50, 110] and linear.product(v, linear.product(m, v)).first()["v"] == 2700
    assert linear.trace(m).first()["v"] == 5 and linear.frobenius(m).first()["v"] == pytest.approx(math.sqrt(30))
    assert dense(linear.matrix_power(m, 5, 2), 2, 2).tolist() == np.linalg.matrix_power([[1, 2], [3, 4]], 5).tolist()
    assert dense(linear.matrix_power(m, -3, 2), 2, 2).tolist() == [[1, 0], [0, 1]]
    assert dense(linear.add_scalar(m, 2, 2), 2, 2).tolist() == [[3, 2], [3, 6]]
    z = spark.createDataFrame([(0, 1, 1.0, 2.0)], "i int, j int, re double, im double")
    assert tuple(linear.adjoint(z).first()) == (1, 0, 1.0, -2.0)
    assert tuple(linear.matrix_product(linear.adjoint(z), z).first()) == (1, 1, 5.0, 0.0)
    assert tuple(linear.contract(z, z, ["i", "j"]).first()) == (5.0, 0.0) and tuple(linear.contract(z, z, ["i", "j"], conjugate_a=False).first()) == (-3.0, 4.0)
    dets = matrix(spark, [[1, 1], [0, 2]]).withColumn("k", F.lit(1)).unionByName(matrix(spark, [[1, 2], [3, 4]]).withColumn("k", F.lit(2)))
    assert dict(linear.determinants(dets, ["k"], 2).collect()) == {1: pytest.approx(2), 2: pytest.approx(-2)}


def test_block_product_with_scalar_blocks(spark):
    cells = [(0, 0, None, None, 2.0), (0, 1, 0, 0, 1.0), (0, 1, 1, 1, 3.0)]
    b = spark.createDataFrame(cells, "bi int, bj int, i int, j int, v double")
    c = spark.createDataFrame([(0, 0, 0, 1, 5.0), (1, 0, None, None, 10.0)], "bi int, bj int, i int, j int, v double")
    got = {tuple(r)[:4]: r["v"] for r in linear.block_product(b, c).collect()}
    assert got == {(0, 0, 0, 1): 10.0, (0, 0, 0, 0): 10.0, (0, 0, 1, 1): 30.0}


def test_forms_agree(spark):
    df = spark.range(3).select("id", P.generate(F.col("id") + 2, lambda i: P.generate(3, lambda j: (i * 3 + j + F.col("id")).cast("double"))).alias("m"))
    long = plans.to_long(df, "m")
    back = plans.to_packed(long, ["id"], ["i0", "i1"], name="m")
    assert sorted(df.collect()) == sorted(back.collect()) and plans.column_rank(df, "m") == 2
    packed = dict(df.select("id", P.frobenius("m")).collect())
    assert {r["id"]: math.sqrt(r["q"]) for r in long.groupBy("id").agg(F.sum(F.col("v") ** 2).alias("q")).collect()} == pytest.approx(packed)
    assert plans.prefers_long(10**6) and plans.tensor_type(2).simpleString() == "array<array<double>>"


def test_statistics(spark):
    df = vector(spark, [-1, 0, 1, 2.5, 5, 9.99, 10, 11])
    assert [r["count"] for r in statistics.histogram(df, "v", 5, 0, 10).orderBy("class").collect()] == [2, 1, 1, 0, 2]
    assert sorted(statistics.class_members(df, "i", "v", 5, 0, 10).collect()) == [(0, 1), (0, 2), (1, 3), (2, 4), (4, 5), (4, 6)]
    w = vector(spark, [1, 1, 2, 5, 1])
    assert statistics.weighted_median(w, "i", "v").first()["median"] == 2
    e = statistics.extremes(vector(spark, [1, 5, 5, 1]), ["i"], "v").first()
    assert (e["maximum"], e["max_i"], e["minimum"], e["min_i"]) == (5, 1, 1, 0)
    s = {r["i"]: r["rank"] for r in statistics.argsort(vector(spark, [2, 1, 2, 0]), "i", "v").collect()}
    assert s == {3: 0, 1: 1, 0: 2, 2: 3}
    run = order.running_sum(spark.range(100).withColumn("v", F.lit(1)), "id", "v", width=7)
    assert all(r["running"] == r["id"] + 1 for r in run.collect())


def test_observables(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(size=(120, 2))
    df = spark.createDataFrame([(i, float(x)) for i in range(120) for x in a[i]], "step int, v double")
    cells = observables.cube(df, F.col("step"), F.lit("o"), F.col("v")).cache()
    s = observables.summary(cells).first()
    assert s["mean"] == pytest.approx(a.mean()) and s["sd"] == pytest.approx(a.std(ddof=1))
    j = observables.jackknife_error(cells).first()["jackknife"]
    assert j == pytest.approx(a.mean(axis=1).std(ddof=1) / math.sqrt(120))  # equal counts
    whole = observables.report(cells).first()
    assert (whole["mean"], whole["sd"], whole["jackknife"], whole["steps"]) == (pytest.approx(s["mean"]), pytest.approx(s["sd"]), pytest.approx(j), 120)
    binned = observables.binning(cells, 10)
    assert observables.summary(binned).first()["mean"] == pytest.approx(a.mean()) and binned.count() == 10
    assert binned.where("step = 3").first()["s"] == pytest.approx(a[36:48].mean())
    assert observables.binning(cells, 500).count() == 120
    means = observables.sample_means(observables.bootstrap(cells, 300, 120, 120))
    assert means.where("sample = 0").first()["theta"] == pytest.approx(a.mean())
    assert observables.sample_error(means).first()["error"] == pytest.approx(j, rel=0.5)
    assert observables.empty_cube(spark, 2, 3, 2).count() == 12
    assert observables.summary(observables.merge(cells, cells)).first()["mean"] == pytest.approx(a.mean())
    one = observables.cube(df.limit(1), F.col("step"), F.lit("o"), F.col("v"))
    assert observables.report(one).first()["sd"] is None and observables.report(one).first()["jackknife"] is None
    assert observables.summary(one).first()["sd"] is None and observables.jackknife_means(one).first()["theta"] is None


def spectrum_of(df):
    rows = sorted(df.collect(), key=lambda r: r["p"])
    return np.array([complex(r["re"], r["im"]) for r in rows])


def test_signal(spark):
    v = [math.sin(2 * math.pi * i / 10) for i in range(1024)]
    x = vector(spark, v)
    f = spectrum_of(signal.spectrum(x, 1024))
    assert np.allclose(f, np.fft.fft(v)) and int(np.abs(f[:512]).argmax()) == 102
    w = np.random.default_rng(0).normal(size=60)
    y = vector(spark, w)
    want = np.fft.fft(w)
    for got in (signal.spectrum(y, 60), signal.two_stage_fft(y, 60), signal.two_stage_fft(y, 60, 5)):
        assert np.allclose(spectrum_of(got), want)
    assert np.allclose(spectrum_of(signal.transform(y, 60, scale=2)), want[::2])
    assert (np.abs(want) ** 2).sum() / 60 == pytest.approx((w**2).sum())
    assert signal.inverse(signal.transform(y, 60), 7.0, 60).first()["re"] == pytest.approx(w[7])
    m = signal.momentum(y, 3.0, 60).first()
    assert complex(m["re"], m["im"]) == pytest.approx(want[3])
    ac = {r["t"]: r for r in signal.autocorrelation(y, 5).collect()}
    for t in range(6):
        p = w[: 60 - t] * w[t:]
        assert ac[t]["ac"] == pytest.approx(p.mean() / (w**2).mean()) and ac[t]["sd"] == pytest.approx(p.std() / math.sqrt(60 - t) / (w**2).mean())
    periodic = {r["t"]: r["ac"] for r in signal.autocorrelation(y, 59, periodic=True, normalise=False).collect()}
    assert periodic[59] == pytest.approx((w * np.roll(w, -59)).mean())


@pytest.mark.parametrize("n", [719, 1021, 2 * 523])
def test_transform_of_lengths_without_factors(spark, n, monkeypatch):
    """A prime length goes by way of a longer transform; no piece is as long as the series."""
    w = np.random.default_rng(n).normal(size=n)
    x = vector(spark, w)
    assert np.allclose(spectrum_of(signal.two_stage_fft(x, n)), np.fft.fft(w))
    assert np.allclose(spectrum_of(signal.chirp_fft(x, n)), np.fft.fft(w))
    monkeypatch.setattr(signal, "ONE_TASK", 512)
    assert np.allclose(spectrum_of(signal.spectrum(x, n)), np.fft.fft(w))


def test_series_by_key(spark, monkeypatch):
    monkeypatch.setattr(signal, "BLOCK", 16)  # many blocks
    w = np.random.default_rng(1).normal(size=(3, 50)) + 5
    df = spark.createDataFrame([(k, i, float(w[k, i])) for k in range(3) for i in range(50)], "k int, i int, v double").repartition(4)
    for lag in (3, 20, 49, 70):
        got = {(r["k"], r["t"]): r for r in signal.autocorrelation(df, lag, keys=["k"]).collect()}
        assert set(got) == {(k, t) for k in range(3) for t in range(min(lag, 49) + 1)}
        for k, t in got:
            p = w[k, : 50 - t] * w[k, t:]
            assert got[k, t]["ac"] == pytest.approx(p.mean() / (w[k] ** 2).mean()) and got[k, t]["sd"] == pytest.approx(p.std() / math.sqrt(50 - t) / (w[k] ** 2).mean(), abs=1e-12)
        around = {(r["k"], r["t"]): r["ac"] for r in signal.autocorrelation(df, lag, periodic=True, normalise=False, keys=["k"]).collect()}
        assert set(around) == {(k, t) for k in range(3) for t in range(lag + 1)}
        assert all(a == pytest.approx((w[k] * np.roll(w[k], -t)).mean()) for (k, t), a in around.items())
    m = {r["k"]: complex(r["re"], r["im"]) for r in signal.momentum(df, 2.0, 50, keys=["k"]).collect()}
    assert all(m[k] == pytest.approx(np.fft.fft(w[k])[2]) for k in range(3))
    f = signal.transform(df, 50, keys=["k"])
    back = {r["k"]: r["re"] for r in signal.inverse(f, 4.0, 50, keys=["k"]).collect()}
    assert all(back[k] == pytest.approx(w[k, 4]) for k in range(3))
    holes = df.where("i <> 7").unionByName(spark.createDataFrame([(0, 7, None)], df.schema))
    p = np.delete(w[1] * np.roll(w[1], -1), [6, 7, 49])
    assert {r["t"]: r["ac"] for r in signal.autocorrelation(holes, 1, normalise=False, keys=["k"]).where("k = 1").collect()}[1] == pytest.approx(p.mean())


def test_complex_algebra(spark):
    rng = np.random.default_rng(3)
    a, b, v = (rng.normal(size=s) + 1j * rng.normal(size=s) for s in ((4, 4), (4, 4), (4,)))
    m = lambda x: spark.createDataFrame([(i, j, float(x[i, j].real), float(x[i, j].imag)) for i in range(4) for j in range(4)], "i int, j int, re double, im double")
    x = spark.createDataFrame([(i, float(v[i].real), float(v[i].imag)) for i in range(4)], "i int, re double, im double")
    full = lambda df: np.array([[{(r["i"], r["j"]): complex(r["re"], r["im"]) for r in df.collect()}.get((i, j), 0) for j in range(4)] for i in range(4)])
    real = linear.identity(spark, 4)
    assert np.allclose(full(linear.product(m(a), m(b))), a @ b) and np.allclose(full(linear.product(m(a), real)), a)
    assert np.allclose(full(linear.scale(m(a), 2 - 1j)), (2 - 1j) * a) and np.allclose(full(linear.add(m(a), m(b))), a + b)
    assert np.allclose(full(linear.add_scalar(m(a), 3, 4)), a + 3 * np.eye(4)) and np.allclose(full(linear.add(real, m(a))), a + np.eye(4))
    assert np.allclose(full(linear.matrix_power(m(a), 5, 4)), np.linalg.matrix_power(a, 5)) and np.allclose(full(linear.matrix_power(m(a), 0, 4)), np.eye(4))
    got = {r["i"]: complex(r["re"], r["im"]) for r in linear.product(m(a), x).collect()}
    assert np.allclose([got[i] for i in range(4)], a @ v)
    t = linear.trace(m(a)).first()
    assert complex(t["re"], t["im"]) == pytest.approx(np.trace(a)) and linear.frobenius(m(a)).first()["v"] == pytest.approx(np.linalg.norm(a))
    assert linear.norm(x).first()["v"] == pytest.approx(np.linalg.norm(v)) and linear.square_norm(x).first()["v"] == pytest.approx(np.linalg.norm(v) ** 2)
    d = linear.determinants(m(a).withColumn("k", F.lit(1)), ["k"], 4).first()
    assert complex(d["re"], d["im"]) == pytest.approx(np.linalg.det(a))


def test_gram(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in a] + [(None,)], "v array<double>").repartition(5)
    got = {(r["i"], r["j"]): r["v"] for r in linear.gram(df, "v").collect()}
    assert np.allclose([[got[i, j] for j in range(5)] for i in range(5)], a.T @ a) and linear.gram(df.limit(0), "v").count() == 0


def test_indices_of_long_tensors(spark):
    x = vector(spark, range(10))
    series = lambda df: [r["v"] for r in sorted(df.collect(), key=lambda r: r["i"])]
    assert series(arrays.rotate(x, 3, 10)) == [*range(3, 10), 0, 1, 2] and series(arrays.rotate(x, -2, 10)) == [8, 9, *range(8)]
    assert series(arrays.shift(x, -4)) == list(range(4, 10)) and {r["i"]: r["v"] for r in arrays.shift(x, 2).collect()} == {i + 2: i for i in range(10)}
    assert series(arrays.interval(x, "i", 2, 5)) == [2, 3, 4, 5]
    m = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(5) for j in range(7)], "i int, j long, v double")
    b = arrays.blockify(m, {"i": 2, "j": 3})
    assert {(r["bi"], r["bj"], r["i"], r["j"]) for r in b.collect()} == {(i // 2, j // 3, i % 2, j % 3) for i in range(5) for j in range(7)}
    assert sorted(arrays.deblockify(b, {"i": 2, "j": 3}).select("i", "j", "v").collect()) == sorted(m.collect())
    assert sorted(arrays.sub_array(m, "j", 4).collect()) == [(i, float(10 * i + 4)) for i in range(5)]


def test_calculus(spark):
    x = vector(spark, [i * i / 4 for i in range(9)])
    d = {r["i"]: r["d"] for r in calculus.central_difference(x, 0.5).collect()}
    assert d[0] is None and d[8] is None and d[3] == pytest.approx(3.0)
    assert {r["i"]: r["d"] for r in calculus.forward_difference(x, 0.5).collect()}[8] is None
    assert calculus.integrate(spark, lambda x: x * x, 0, 1, 100).first()[0] == pytest.approx(0.33335)
    assert calculus.integrate(spark, lambda x: x * x, 0, 1, 3, "simpson").first()[0] == pytest.approx(1 / 3)
    assert calculus.integrate_series(x, 0.5, 8, "simpson").first()[0] == pytest.approx(64 / 3)


MODELS = [fit.Exponentials(2, True, 0.1, 0.2), fit.SingleGaussian(2, -0.3, 0.5, False), fit.Gaussians([1.0, 2.0], [0.7], [0.1, 1.0], (False, False, False), True), fit.Lorentzians([1.0, -2.0], [0.7, 1.1], [0.2], (False, False, False), True)]


@pytest.mark.parametrize("model", MODELS, ids=lambda m: type(m).__name__)
def test_model_derivatives(model):
    x = np.linspace(-1, 2, 9)
    p = model.parameters() + 0.05
    for j in range(len(p)):
        assert fit.gradient_ratio(model, x, p, j) == pytest.approx(np.ones(9), rel=1e-4)


def test_fit(spark):
    rows = [(k, float(x), (k + 1) * math.exp(-0.5 * x * x), 0.1) for k in range(2) for x in np.linspace(-2, 2, 20)]
    df = spark.createDataFrame(rows, "k int, x double, y double, sigma double")
    for r in fit.fit(df, ["k"], fit.SingleGaussian()).collect():
        assert r["parameters"] == pytest.approx([r["k"] + 1, -0.5], abs=1e-6) and r["chi2"] == pytest.approx(0, abs=1e-10)
    few = spark.createDataFrame([(0, 1.0), (0, 2.0)], "k int, y double")
    assert fit.fit(few, ["k"], fit.SingleGaussian(), x=None, sigma=None, order="y").first()["chi2"] is None
    with pytest.raises(ValueError):  # rows have no order of their own
        fit.fit(few, ["k"], fit.SingleGaussian(), x=None, sigma=None)
    fixed = fit.Peaks([1.0], [2.0, 3.0], [0.0, 1.0, 2.0], (False, True, False))
    values, source = fixed.unpack(np.array([9.0, 5.0, 6.0, 7.0]))
    assert values.tolist() == [[9, 9, 9], [2, 3, 2], [5, 6, 7]] and [s.tolist() for s in source] == [[0, 0, 0], [-1, -1, -1], [1, 2, 3]]


def test_fit_in_the_order_of_a_column(spark):
    """Points without x count from 0 in that order, however they lie; null x likewise, beside given ones."""
    df = spark.createDataFrame([(k, 100 - t, k + 2.0 * (100 - t), None) for k in range(2) for t in range(100)], "k int, t int, y double, x double").repartition(8)
    for x in (None, "x"):
        for r in fit.fit(df, ["k"], Line(), x=x, sigma=None, order="t").collect():
            assert r["parameters"] == pytest.approx([r["k"] + 2, 2], abs=1e-6)


def test_trace_of_a_fit(spark):
    df = spark.createDataFrame([(0, float(x), 3 * math.exp(-0.5 * x * x)) for x in np.linspace(-2, 2, 20)], "k int, x double, y double")
    r = fit.fit(df, ["k"], fit.SingleGaussian(), sigma=None, trace=True).first()
    assert len(r["trace"]) == r["iterations"] and r["trace"][0].startswith("iteration 1: chi^2 ")
    assert "trace" not in fit.fit(df, ["k"], fit.SingleGaussian(), sigma=None).columns


def test_a_fit_is_a_minimum(spark):
    rng = np.random.default_rng(12)
    x = np.linspace(0, 10, 41)
    y = 50 * np.exp(-0.5 * ((x - 4) / 1.5) ** 2) + rng.normal(size=41)
    df = spark.createDataFrame([(0, float(a), float(b), 1.0) for a, b in zip(x, y, strict=True)], "k int, x double, y double, sigma double")
    model = fit.Gaussians([10.0], [1.0], [5.0], (False, False, False))
    r = fit.fit(df, ["k"], model).first()
    p = np.array(r["parameters"])
    chi = lambda q: ((model.value(x, q) - y) ** 2).sum()
    assert r["chi2"] * 38 == pytest.approx(chi(p)) and p == pytest.approx([50, 1.5, 4], rel=0.05)
    for j in range(3):
        for h in (-1e-3, 1e-3):
            assert chi(p + h * np.eye(3)[j]) > chi(p)


def test_remove_excited_states(spark):
    """Two exponentials: what is left is the fitted sum where the data lay, and replicates keep their differences."""
    t = np.arange(30) / 3
    noise = np.random.default_rng(2).normal(size=(6, 30)) * 1e-4
    noise[0] = 0
    clean = 2 * np.exp(-0.5 * t)
    v = clean + np.exp(-3 * t) + noise  # the second term dies out before t = 4
    rows = [(k, r, float(t[i]), float(v[r, i] * (k + 1))) for k in range(2) for r in range(6) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, replicate int, t double, v double")
    got = {(r["k"], r["replicate"], round(r["t"], 6)): r["v"] for r in fit.remove_excited_states(df, 1, 4.0, 9.0, keys=["k"], start=[1.0, -0.3]).collect()}
    assert len(got) == len(rows)
    for (k, r, at), value in got.items():
        i = int(round(at * 3))
        assert value == pytest.approx((k + 1) * (clean[i] + noise[r, i]), abs=0.02 * (k + 1))
        assert value - got[k, 0, at] == pytest.approx((k + 1) * noise[r, i], abs=1e-9)


def test_text_files(spark, tmp_path):
    f = tmp_path / "m.txt"
    f.write_text("skip me\n# comment\n\n1 2  3\n4 x\n  5 6 7 8\n3x 1e2 -.5\n")
    m = {(r["i"], r["j"]): r["v"] for r in text.read_matrix(spark, str(f), skip=1).collect()}
    assert [[m[i, j] for j in range(3)] for i in range(4)] == [[1, 2, 3], [4, 0, 0], [5, 6, 7], [3, 100, -0.5]]
    assert text.read_matrix(spark, str(f), skip=1, kind="int").where("i = 3 and j = 0").first()["v"] == 3
    (tmp_path / "empty.txt").write_text("# nothing\n")
    assert text.read_matrix(spark, str(tmp_path / "empty.txt")).count() == 0
    big = tmp_path / "big.txt"
    big.write_text("".join(f"{i} {i * 2}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text.read_matrix(spark, str(big), skip=10).where("j = 0").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["i"], r["v"]) for r in got) == [(i, i + 10) for i in range(4990)]
    out = str(tmp_path / "out")
    text.write(matrix(spark, [[1, 0], [0, 4]]), out)
    text.write(matrix(spark, [[5, 6]]), out, append=True)
    assert text.read_matrix(spark, out).count() == 6
    text.write_tensor(spark.createDataFrame([(1, 2, 3, 4.5)], "a int, b int, c int, v double"), str(tmp_path / "t"), ["a", "b", "c"])
    assert spark.read.text(str(tmp_path / "t")).first()["value"] == "1 2 3   4.5"
    cells = observables.empty_cube(spark, 2, 2, 4).withColumn("s", F.col("step") * 8 + F.col("observable") * 4 + F.col("idx") + 0.5)
    text.export_cube(cells.where("idx > 0"), str(tmp_path / "c"), 2, 2, [2, 2])
    got = {(r["step"], r["observable"], r["idx"]): r["s"] for r in text.import_cube(spark, str(tmp_path / "c")).collect()}
    assert len(got) == 16 and got[1, 1, 3] == 15.5 and got[1, 0, 0] == 0


def test_streaming_moments(spark, tmp_path):
    rows = spark.range(100).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), (F.col("id") % 2).alias("o"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_moments(stream, "ts", F.col("o"), F.col("v"), "30 minutes", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("moments").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    batch = windowed_moments(rows, "ts", F.col("o"), F.col("v"), "30 minutes")
    assert sorted(spark.table("moments").collect()) == sorted(batch.collect()) and batch.count() == 8


def test_late_rows_of_a_stream(spark, tmp_path):
    """Rows behind the watermark are left out; those that are late but not behind it count."""
    at = lambda *minutes: spark.createDataFrame([(m * 60, "o", 1.0) for m in minutes], "s long, o string, v double").select(F.timestamp_seconds("s").alias("ts"), "o", "v")
    schema = at(0).schema
    os.makedirs(tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windowed_moments(stream, "ts", F.col("o"), F.col("v"), "10 minutes", "20 minutes").writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "ck")).start()
    for minutes in ((1, 2, 100), (5, 85), (200,), (201,)):  # at minute 100 the watermark is 80: 5 is behind it, 85 is not
        at(*minutes).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    got = {int(r["s"]): r["c"] for r in spark.table("late").selectExpr("unix_timestamp(start) / 60 as s", "c").collect()}
    assert got == {0: 2.0, 80: 1.0, 100: 1.0}


def test_shell(spark, tmp_path, capsys):
    assert float(evaluate(spark, "3.3 + 7").first()[0]) == pytest.approx(10.3)
    assert evaluate(spark, "sum(v)", ["CREATE OR REPLACE TEMP VIEW t AS SELECT explode(sequence(1, 3)) AS v"], "t").first()[0] == 6
    assert evaluate(spark, "packed.norm(packed.literal([3, 4]))", python=True).first()[0] == 5
    main(["sqrt(9)", "--script", str(tmp_path / "run.py")])
    assert "sqrt(9)" in (tmp_path / "run.py").read_text() and "evaluate" in script("1")


def test_random_deviation(spark):
    row = spark.range(20_000).select(P.random(2.0, seed=3).alias("x")).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max("x").alias("top")).first()
    assert row["m"] == pytest.approx(1, abs=0.02) and row["s"] == pytest.approx(2 / math.sqrt(12), abs=0.02) and row["top"] < 2
