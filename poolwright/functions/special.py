"""Distribution functions that Spark SQL lacks, in plain Python and as vectorised column functions.

Incomplete beta and gamma functions by continued fraction and series; quantiles by bisection on
them. The normal quantile is the standard library's.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()
#: two-sided 95 % point of the normal distribution
Z95 = 1.959963984540054


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function (Lentz's continued fraction)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h / a


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        total = term = 1 / a
        n = a
        for _ in range(10_000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-17:
                break
        return front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def t_sf(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def chi2_sf(x: float, df: float) -> float:
    return 1.0 - gamma_inc(df / 2, x / 2)


def _bisect(f, low: float, high: float) -> float:
    """Root of an increasing function."""
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


@lru_cache(maxsize=65_536)
def t_ppf(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1 - p, df)
    high = 1.0
    while t_sf(high, df) > 1 - p:
        high *= 2
    return _bisect(lambda t: (1 - p) - t_sf(t, df), 0.0, high)


@lru_cache(maxsize=65_536)
def chi2_ppf(p: float, df: float) -> float:
    high = max(1.0, df)
    while 1 - chi2_sf(high, df) < p:
        high *= 2
    return _bisect(lambda x: (1 - chi2_sf(x, df)) - p, 0.0, high)


def _columnwise(f):
    """A pandas UDF over double columns; null where an input is null or outside the domain."""

    def one(*args: float) -> float | None:
        try:
            return None if any(a is None or a != a for a in args) else f(*args)
        except (ValueError, OverflowError, ZeroDivisionError):
            return None

    return one


@F.pandas_udf(T.DoubleType())
def _t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    f = _columnwise(lambda a, b: t_ppf(a, b) if 0 < a < 1 and b > 0 else None)
    return pd.Series([f(a, b) for a, b in zip(p, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    f = _columnwise(lambda a, b: 2 * t_sf(abs(a), b) if b > 0 else None)
    return pd.Series([f(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    f = _columnwise(lambda a: 2 * normal_sf(abs(a)))
    return pd.Series([f(a) for a in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _normal_ppf(p: pd.Series) -> pd.Series:
    f = _columnwise(lambda a: normal_ppf(a) if 0 < a < 1 else None)
    return pd.Series([f(a) for a in p], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    f = _columnwise(lambda a, b: chi2_sf(a, b) if b > 0 else None)
    return pd.Series([f(a, b) for a, b in zip(x, df, strict=True)], dtype="float64")


def t_quantile(p: Column | float, df: Column) -> Column:
    return _t_ppf((p if isinstance(p, Column) else F.lit(p)).cast("double"), df.cast("double"))


def t_p_value(t: Column, df: Column) -> Column:
    return _t_two_sided(t.cast("double"), df.cast("double"))


def normal_p_value(z: Column) -> Column:
    return _normal_two_sided(z.cast("double"))


def normal_quantile(p: Column) -> Column:
    return _normal_ppf(p.cast("double"))


def chi2_p_value(x: Column, df: Column) -> Column:
    return _chi2_sf(x.cast("double"), df.cast("double"))


def lgamma(x: Column) -> Column:
    """log Γ(x), x > 0, in JVM expressions: Stirling's series eight steps up."""
    up = x + 8
    series = 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - 1 / (1680 * up**7) + 1 / (1188 * up**9)
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - F.log(steps)
