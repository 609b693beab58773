"""Non-linear least squares by Levenberg-Marquardt, one fit for each key's points.

A model gives values and derivatives over numpy arrays; the fit runs in the task that holds the key's points. Points
are (keys..., x, y, sigma). Points without x (no column, or null) are numbered from 0 in the order of another column; a
missing sigma is 1. With trace on, each fit keeps a line for each iteration.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

MAX_ITERATIONS, TOLERANCE = 10_000, 1e-8


class Model:
    """parameters(): start values; value(x, p) and jacobian(x, p) over an array x."""

    def parameters(self) -> np.ndarray:
        raise NotImplementedError

    def value(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def jacobian(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Columns are derivatives by each parameter; central differences unless a model knows better."""
        out = np.empty((len(x), len(p)))
        for j in range(len(p)):
            h = 1e-6 * max(1.0, abs(p[j]))
            up, down = p.copy(), p.copy()
            up[j] += h
            down[j] -= h
            out[:, j] = (self.value(x, up) - self.value(x, down)) / (2 * h)
        return out


def gradient_ratio(model: Model, x: np.ndarray, p: np.ndarray, j: int, h: float = 1e-6) -> np.ndarray:
    """Difference quotient over the model's own derivative; tends to 1 where that is right."""
    up, down = p.copy(), p.copy()
    up[j] += h
    down[j] -= h
    return (model.value(x, up) - model.value(x, down)) / (2 * h) / model.jacobian(x, p)[:, j]


@dataclass
class Exponentials(Model):
    """Sum of a (exp(b (x + c1)) + exp(-b (x + c2))), the second term with cosh only; a and b are fitted."""

    terms: int = 1
    cosh: bool = False
    c1: float = 0.0
    c2: float = 0.0
    start: list[float] | None = None

    def parameters(self):
        return np.array(self.start if self.start is not None else [s for i in range(self.terms) for s in (0.1, 0.1 * i)], float)

    def value(self, x, p):
        out = np.zeros(len(x))
        for a, b in p.reshape(-1, 2):
            out += a * (np.exp(b * (x + self.c1)) + (np.exp(-b * (x + self.c2)) if self.cosh else 0))
        return out

    def jacobian(self, x, p):
        columns = []
        for a, b in p.reshape(-1, 2):
            up, down = np.exp(b * (x + self.c1)), np.exp(-b * (x + self.c2)) if self.cosh else np.zeros(len(x))
            columns += [up + down, a * ((x + self.c1) * up - (x + self.c2) * down)]
        return np.stack(columns, axis=1)


@dataclass
class SingleGaussian(Model):
    """a exp(e (x - x0)^2); x0 stays unless free."""

    a: float = 1.0
    e: float = -1.0
    x0: float = 0.0
    x0_fixed: bool = True

    def parameters(self):
        return np.array([self.a, self.e] + ([] if self.x0_fixed else [self.x0]))

    def value(self, x, p):
        return p[0] * np.exp(p[1] * (x - (self.x0 if self.x0_fixed else p[2])) ** 2)

    def jacobian(self, x, p):
        d = x - (self.x0 if self.x0_fixed else p[2])
        e = np.exp(p[1] * d**2)
        return np.stack([e, p[0] * d**2 * e] + ([] if self.x0_fixed else [-2 * p[0] * p[1] * d * e]), axis=1)


@dataclass
class Peaks(Model):
    """Sums of peaks with amplitude, scale and centre. A category lists a value for each peak, or fewer that the peaks
    share in turn; fixed categories are not fitted. symmetrise adds each peak at -x."""

    amplitude: list[float] = field(default_factory=lambda: [1.0])
    scale: list[float] = field(default_factory=lambda: [1.0])
    centre: list[float] = field(default_factory=lambda: [0.0])
    fixed: tuple[bool, bool, bool] = (False, False, True)
    symmetrise: bool = False

    def categories(self) -> list[list[float]]:
        return [self.amplitude, self.scale, self.centre]

    def parameters(self):
        return np.array([v for c, f in zip(self.categories(), self.fixed, strict=True) if not f for v in c], float)

    def unpack(self, p: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Values by category and peak, and which parameter each came from (-1: fixed)."""
        peaks = max(map(len, self.categories()))
        values, source, at = [], [], 0
        for own, fixed in zip(self.categories(), self.fixed, strict=True):
            turn = np.arange(peaks) % len(own)
            values.append(np.array(own, float)[turn] if fixed else p[at + turn])
            source.append(np.full(peaks, -1) if fixed else at + turn)
            at += 0 if fixed else len(own)
        return np.array(values), source

    def peak(self, x, a, s, c):
        raise NotImplementedError

    def slopes(self, x, a, s, c):
        """Derivatives of a peak by amplitude, scale and centre."""
        raise NotImplementedError

    def value(self, x, p):
        values, _ = self.unpack(p)
        return sum(self.peak(side * x, *v) for v in values.T for side in ((1, -1) if self.symmetrise else (1,)))

    def jacobian(self, x, p):
        values, source = self.unpack(p)
        out = np.zeros((len(x), len(p)))
        for k, v in enumerate(values.T):
            for side in (1, -1) if self.symmetrise else (1,):
                for category, d in enumerate(self.slopes(side * x, *v)):
                    if source[category][k] >= 0:
                        out[:, source[category][k]] += d
        return out


class Gaussians(Peaks):
    def peak(self, x, a, s, c):
        return a * np.exp(-0.5 * ((x - c) / s) ** 2)

    def slopes(self, x, a, s, c):
        e, d = np.exp(-0.5 * ((x - c) / s) ** 2), x - c
        return e, a * e * d**2 / s**3, a * e * d / s**2


class Lorentzians(Peaks):
    """|a| / (pi |s| (1 + ((x - c) / s)^2))"""

    def peak(self, x, a, s, c):
        return np.abs(a) / (np.pi * np.abs(s) * (1 + ((x - c) / s) ** 2))

    def slopes(self, x, a, s, c):
        u = (x - c) / s
        base = 1 / (np.pi * np.abs(s) * (1 + u**2))
        return np.sign(a) * base, np.abs(a) * base / s * (2 * u**2 / (1 + u**2) - 1), np.abs(a) * base * 2 * u / s / (1 + u**2)


def least_squares(model: Model, x: np.ndarray, y: np.ndarray, sigma: np.ndarray, trace: list[str] | None = None) -> tuple[np.ndarray, float, int]:
    """Parameters, chi^2 over degrees of freedom (nan without any) and iterations; lines for each are added to trace."""
    p = model.parameters()
    weigh = lambda q: (model.value(x, q) - y) / sigma
    r, damping, n = weigh(p), 1e-3, 0
    for n in range(1, MAX_ITERATIONS + 1):
        j = model.jacobian(x, p) / sigma[:, None]
        normal, slope = j.T @ j, j.T @ r
        diagonal = np.maximum(np.diag(normal), 1e-30)
        step = -np.linalg.lstsq(normal + damping * np.diag(diagonal), slope, rcond=None)[0]
        with np.errstate(all="ignore"):
            trial = weigh(p + step)
        better = np.all(np.isfinite(trial)) and trial @ trial <= r @ r
        if trace is not None:
            trace.append(f"iteration {n}: chi^2 {r @ r:.9g}, damping {damping:.3g}, parameters {' '.join(f'{q:.9g}' for q in p)}")
        if better:
            p, r, damping = p + step, trial, max(damping / 10, 1e-12)
        else:
            damping *= 10
        if np.all(np.abs(step) <= TOLERANCE + TOLERANCE * np.abs(p)) and (better or damping > 1e12):
            break
    free = len(x) - len(p)
    return p, float(r @ r / free) if free > 0 else float("nan"), n


def fit(
    df: DataFrame, keys: list[str], model: Callable[[pd.DataFrame], Model] | Model, x: str | None = "x", y: str = "y", sigma: str | None = "sigma",
    order: str | None = None, trace: bool = False,
) -> DataFrame:
    """keys, parameters, chi2 (over degrees of freedom; null without any), iterations, and on request trace (a line for
    each iteration). model may be made from the points. order: the column in whose order points without x count as 0, 1,
    2, ...; rows of a table have no other order, so it must be given where x is missing."""
    ship(df.sparkSession)
    if x is None and order is None:
        raise ValueError("points without x need a column that orders them")
    place = F.col(order) if order else F.lit(0)
    columns = [*keys, F.col(y).cast("double").alias("_y"), (F.col(x).cast("double") if x else F.lit(None).cast("double")).alias("_x"), (F.col(sigma).cast("double") if sigma else F.lit(1.0)).alias("_s"), place.alias("_o")]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if order:
            rows = rows.sort_values("_o", kind="stable")
        xs = rows["_x"].to_numpy(float)
        if not order and np.isnan(xs).any():
            raise ValueError("points without x need a column that orders them")
        xs = np.where(np.isnan(xs), np.arange(len(xs)), xs)
        by_x = np.argsort(xs, kind="stable")
        own = model if isinstance(model, Model) else model(pd.DataFrame({"x": xs[by_x], "y": rows["_y"].to_numpy(float)[by_x]}))
        lines = [] if trace else None
        p, chi, n = least_squares(own, xs[by_x], rows["_y"].to_numpy(float)[by_x], rows["_s"].fillna(1.0).to_numpy(float)[by_x], lines)
        out = {**{k: [v] for k, v in zip(keys, key, strict=True)}, "parameters": [p.tolist()], "chi2": [None if np.isnan(chi) else chi], "iterations": [n]}
        return pd.DataFrame(out | ({"trace": [lines]} if trace else {}))

    schema = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys) + "parameters array<double>, chi2 double, iterations int" + (", trace array<string>" if trace else "")
    return df.select(*columns).groupBy(*keys).applyInPandas(one, schema)


def remove_excited_states(table: DataFrame, terms: int, low: float, high: float, keys: list[str] | None = None, start: list[float] | None = None) -> DataFrame:
    """table: (keys..., t, replicate, v), replicate 0 the data. Fits a sum of exponentials to replicate 0 between low and
    high, with the deviation over replicates as sigma, and moves every replicate by the fit less the data; the last
    term alone stays beyond the fit's other terms."""
    keys = keys or []
    base = table if keys else table.withColumn("_all", F.lit(0))
    own = keys or ["_all"]
    spread = base.groupBy(*own, "t").agg(F.stddev_samp("v").alias("sigma"), F.max(F.when(F.col("replicate") == 0, F.col("v"))).alias("y"))
    window = spread.where(F.col("t").between(low, high)).withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0))
    fitted = fit(window, own, Exponentials(terms, start=start), x="t")
    model = F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), F.lit(0.0), lambda s, k: s + F.get(F.col("parameters"), 2 * k) * F.exp(F.get(F.col("parameters"), 2 * k + 1) * F.col("t")))
    moved = spread.join(fitted, own).select(*own, "t", (model - F.col("y")).alias("_shift"))
    return base.join(moved, [*own, "t"]).withColumn("v", F.col("v") + F.col("_shift")).drop("_shift", "_all")
