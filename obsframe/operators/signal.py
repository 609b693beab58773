"""Autocorrelation and Fourier transforms of series: (keys..., i, v), i from 0 without gaps; complex ones (i, re, im).

Lagged products are made block by block: a block of indices travels with the few that follow it, so a series is
shuffled about once, whatever the number of lags. Momenta are exploded and met by partial sums. Whole spectra of long
series go through numpy's FFT, for a series that one task can hold, or through the two-stage transform, which no single
task has to hold; lengths without suitable factors are transformed by way of a longer one (a chirp).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Series up to this length use the direct transform in `spectrum`; up to the second, one task's FFT.
DIRECT, ONE_TASK = 512, 1 << 22
#: Indices of a block of lagged products.
BLOCK = 1 << 16
#: How much longer than the root of the length the longer factor of a two-stage transform may be.
LONGER = 16


def autocorrelation(df: DataFrame, max_lag: int, n: int | None = None, periodic: bool = False, normalise: bool = True, keys: list[str] | None = None) -> DataFrame:
    """keys, t, ac, sd for lags 0 to max_lag: mean of v_i * v_(i+t), no mean subtracted; sd: root of the summed squared
    deviations of the products over their number; both over ac[0] if normalised. n: the length of each series, needed for
    periodic ones and counted if not given. Products with a null or missing value do not count."""
    keys = keys or []
    rows = df.select(*keys, F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    width = max(BLOCK, max_lag)
    place = F.col("i")
    last = F.lit(None).cast("long")
    if periodic:
        # The first values come once more behind the last ones.
        if n is None:
            sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
            rows = rows.join(sizes, keys) if keys else rows.withColumn("_n", F.lit(sizes.first()["_n"]))
        else:
            rows = rows.withColumn("_n", F.lit(n).cast("long"))
        turns = F.when(F.col("_n") > 0, F.floor((F.lit(max_lag) - 1 - F.col("i")) / F.col("_n")) + 1)
        rows = rows.withColumn("i", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(turns, F.lit(0)).cast("long")), lambda k: F.col("i") + k * F.col("_n"))))
        last = F.col("_n")
    low = F.greatest(F.lit(0), F.floor((place - max_lag) / width))
    high = F.floor(place / width) if not periodic else F.least(F.floor(place / width), F.floor((F.col("_n") - 1) / width))
    rows = rows.select(*keys, F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("b"), "i", "v", last.alias("_n"))

    def products(table: pa.Table) -> pa.Table:
        b = table.column("b")[0].as_py()
        i = table.column("i").to_numpy() - b * width
        size = table.column("_n")[0].as_py()
        v = np.full(width + max_lag, np.nan)
        v[i] = table.column("v").to_numpy(zero_copy_only=False)
        home = width if size is None else min(width, size - b * width)
        out = []
        for t in range(max_lag + 1):
            p = v[:home] * v[t : t + home]
            p = p[~np.isnan(p)]
            if len(p):
                out.append((t, len(p), p.mean(), ((p - p.mean()) ** 2).sum()))
        columns = zip(*out) if out else [[]] * 4
        made = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.float64(), pa.float64()))]
        same = [pa.array([table.column(k)[0].as_py()] * len(out), table.schema.field(k).type) for k in keys]
        return pa.Table.from_arrays([*same, *made], names=[*keys, "t", "n", "mean", "square"])

    schema = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys) + "t int, n long, mean double, square double"
    parts = rows.groupBy(*keys, "b").applyInArrow(products, schema)
    sums = parts.groupBy(*keys, "t").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum("square").alias("q"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("m"))
    mean = F.col("s") / F.col("n")
    square = F.col("q") + F.greatest(F.col("m") - F.col("n") * mean * mean, F.lit(0.0))
    out = sums.select(*keys, "t", mean.alias("ac"), (F.sqrt(square / F.col("n")) / F.sqrt(F.col("n"))).alias("sd"))
    if not normalise:
        return out
    zero = F.max(F.when(F.col("t") == 0, F.col("ac"))).over(Window.partitionBy(*keys))  # a row a lag
    return out.select(*keys, "t", F.try_divide("ac", zero).alias("ac"), F.try_divide("sd", zero).alias("sd"))


def _turn(x: Column, p: Column, scale: float, n: int) -> Column:
    """2 pi x p scale / n, reduced first where all is whole."""
    if float(scale).is_integer():
        return 2 * math.pi * F.pmod(x.cast("long") * p * int(scale), F.lit(n)) / n
    return 2 * math.pi * x * p * scale / n


def momentum(df: DataFrame, p: float, n: int, scale: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """keys, re, im of one momentum, whole or not."""
    w = 2 * math.pi * F.col("i") * p * scale / n
    return df.groupBy(*(keys or [])).agg(F.sum(F.col("v") * F.cos(w)).alias("re"), (-F.sum(F.col("v") * F.sin(w))).alias("im"))


def transform(df: DataFrame, n: int, momenta: int | None = None, scale: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """keys, p, re, im for momenta 0 to momenta-1 by the direct sum; momenta: n over scale by default."""
    keys, momenta = keys or [], math.ceil(n / scale) if momenta is None else momenta
    rows = df.select(*keys, "i", F.col("v").cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(momenta - 1))).alias("p"))
    w = _turn(F.col("i"), F.col("p"), scale, n)
    return rows.groupBy(*keys, "p").agg(F.sum(F.col("v") * F.cos(w)).alias("re"), (-F.sum(F.col("v") * F.sin(w))).alias("im"))


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def fft(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p, re, im: numpy's FFT of each key's series."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f = np.fft.fft(rows.sort_values("i")["v"].to_numpy(float))
        out = pd.DataFrame({"p": np.arange(len(f), dtype=np.int32), "re": f.real, "im": f.imag})
        for name, value in zip(keys, key, strict=True):
            out[name] = value
        return out[[*keys, "p", "re", "im"]]

    schema = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys) + "p int, re double, im double"
    return df.groupBy(*keys).applyInPandas(one, schema)


def _factor(n: int) -> int:
    """The largest divisor up to the root."""
    return next(c for c in range(math.isqrt(n), 0, -1) if n % c == 0)


def two_stage_fft(df: DataFrame, n: int, columns: int | None = None) -> DataFrame:
    """p, re, im of one series (i, v), or complex series (i, re, im), of n = rows * columns values: transforms of length
    `rows` for each i mod columns, a twiddle factor, then transforms of length `columns`. No task holds more than one such
    piece; if the length has no factors that keep both short (a prime has none), see chirp_fft."""
    if columns is None:
        columns = _factor(n)
        if n // columns > LONGER * max(math.isqrt(n), LONGER):
            return chirp_fft(df, n)
    rows = n // columns
    source = df if "im" in df.columns else df.select("i", F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))

    def first(part: pd.DataFrame) -> pd.DataFrame:
        b = int(part["b"].iloc[0])
        v = np.zeros(rows, complex)
        v[part["a"].to_numpy()] = part["re"].to_numpy(float) + 1j * part["im"].to_numpy(float)
        y = np.fft.fft(v) * np.exp(-2j * np.pi * (b * np.arange(rows) % n) / n)
        return pd.DataFrame({"k": np.arange(rows), "b": b, "re": y.real, "im": y.imag})

    def second(part: pd.DataFrame) -> pd.DataFrame:
        k = int(part["k"].iloc[0])
        v = np.zeros(columns, complex)
        v[part["b"].to_numpy()] = part["re"].to_numpy() + 1j * part["im"].to_numpy()
        y = np.fft.fft(v)
        return pd.DataFrame({"p": (k + rows * np.arange(columns)).astype(np.int32), "re": y.real, "im": y.imag})

    cells = source.select((F.col("i") % columns).cast("long").alias("b"), F.floor(F.col("i") / columns).alias("a"), "re", "im")
    twisted = cells.groupBy("b").applyInPandas(first, "k long, b long, re double, im double")
    return twisted.groupBy("k").applyInPandas(second, "p int, re double, im double")


def _product(a: str, b: str) -> list[Column]:
    re, im = F.col(f"{a}re") * F.col(f"{b}re") - F.col(f"{a}im") * F.col(f"{b}im"), F.col(f"{a}re") * F.col(f"{b}im") + F.col(f"{a}im") * F.col(f"{b}re")
    return [re.alias("re"), im.alias("im")]


def chirp_fft(df: DataFrame, n: int) -> DataFrame:
    """p, re, im of one series of any length, by a convolution with exp(i pi k^2 / n): two-stage transforms of a power of
    two that holds it, so no task sees the whole series."""
    size = 1 << (2 * n - 1).bit_length()
    source = df if "im" in df.columns else df.select("i", F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    # k^2 modulo 2n, exact for lengths up to some 2^31
    angle = lambda k: F.pmod(k.cast("long") * k.cast("long"), F.lit(2 * n)) * (math.pi / n)
    turned = source.select(F.col("i").cast("long").alias("i"), "re", "im", F.cos(angle(F.col("i"))).alias("c_re"), (-F.sin(angle(F.col("i")))).alias("c_im"))
    turned = turned.select("i", *_product("", "c_"))
    k = F.when(F.col("id") < n, F.col("id")).otherwise(F.lit(size) - F.col("id"))
    chirp = df.sparkSession.range(size).where((F.col("id") < n) | (F.col("id") > size - n)).select(F.col("id").alias("i"), F.cos(angle(k)).alias("re"), F.sin(angle(k)).alias("im"))
    a, b = two_stage_fft(turned, size), two_stage_fft(chirp, size)
    met = a.join(b.select("p", F.col("re").alias("b_re"), F.col("im").alias("b_im")), "p").select(F.col("p").alias("i"), *_product("", "b_"))
    # The inverse transform is the transform of the conjugate, conjugated, over the size.
    back = two_stage_fft(met.withColumn("im", -F.col("im")), size).where(F.col("p") < n)
    back = back.select("p", (F.col("re") / size).alias("re"), (-F.col("im") / size).alias("im"), F.cos(angle(F.col("p"))).alias("c_re"), (-F.sin(angle(F.col("p")))).alias("c_im"))
    return back.select("p", *_product("", "c_"))


def spectrum(df: DataFrame, n: int) -> DataFrame:
    """p, re, im of a whole series by the method that suits its length."""
    if n <= DIRECT:
        return transform(df, n)
    if n <= ONE_TASK:
        return fft(df.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    return two_stage_fft(df, n)


def inverse(spectrum: DataFrame, x: float, n: int, scale: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """keys, re, im of the inverse transform at a real x: the mean over momenta of b_p exp(2 pi i p x scale / n)."""
    w = 2 * math.pi * F.col("p") * x * scale / n
    re, im = F.col("re") * F.cos(w) - F.col("im") * F.sin(w), F.col("re") * F.sin(w) + F.col("im") * F.cos(w)
    return spectrum.groupBy(*(keys or [])).agg((F.sum(re) / n).alias("re"), (F.sum(im) / n).alias("im"))
