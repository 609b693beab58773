"""Complex numbers as struct<re: double, im: double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .packed import Value, _c


def make(re: Value, im: Value = 0.0) -> Column:
    return F.struct(_c(re).cast("double").alias("re"), _c(im).cast("double").alias("im"))


def real(z: Value) -> Column:
    return _c(z)["re"]


def imag(z: Value) -> Column:
    return _c(z)["im"]


def add(a: Value, b: Value) -> Column:
    return make(real(a) + real(b), imag(a) + imag(b))


def multiply(a: Value, b: Value) -> Column:
    return make(real(a) * real(b) - imag(a) * imag(b), real(a) * imag(b) + imag(a) * real(b))


def conjugate(z: Value) -> Column:
    return make(real(z), -imag(z))


def modulus(z: Value) -> Column:
    return F.hypot(real(z), imag(z))


def square_modulus(z: Value) -> Column:
    return real(z) * real(z) + imag(z) * imag(z)


def array_real(v: Value) -> Column:
    return F.transform(_c(v), real)


def array_imag(v: Value, is_complex: bool = True) -> Column:
    """Imaginary parts; zeros for an array of real numbers."""
    return F.transform(_c(v), imag if is_complex else lambda x: F.lit(0.0))


def array_real_complex(v: Value) -> Column:
    return F.transform(_c(v), lambda z: make(real(z)))


def array_imag_complex(v: Value) -> Column:
    return F.transform(_c(v), lambda z: make(imag(z)))


def array_conjugate(v: Value) -> Column:
    return F.transform(_c(v), conjugate)


def array_modulus(v: Value) -> Column:
    return F.transform(_c(v), modulus)


def array_modulus_complex(v: Value) -> Column:
    return F.transform(_c(v), lambda z: make(modulus(z)))


def deviation(v: Value) -> Column:
    """Population deviation: root of mean |z|^2 less |mean z|^2."""
    v, n = _c(v), F.nullif(F.size(_c(v)), F.lit(0))
    plus = lambda s, x: s + x
    square = F.aggregate(F.transform(v, square_modulus), F.lit(0.0), plus)
    re, im = F.aggregate(array_real(v), F.lit(0.0), plus), F.aggregate(array_imag(v), F.lit(0.0), plus)
    return F.sqrt(F.greatest(square / n - (re * re + im * im) / (n * n), F.lit(0.0)))


def text(z: Value) -> Column:
    return F.concat(real(z).cast("string"), F.lit("+i*"), imag(z).cast("string"))
