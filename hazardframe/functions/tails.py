"""Tail probabilities for result tables (one row per tested feature), as Arrow-batched functions.

Spark has no error function or incomplete gamma/beta function. These run on the small table of test statistics only.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T

_TINY = 1e-300


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b, c = x + 1 - a, 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 2000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + step / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else min(1.0, normal_two_sided(v)))


@F.pandas_udf(T.DoubleType())
def chi_square_p(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) or not d > 0 else upper_gamma(d / 2, s / 2) for s, d in zip(statistic, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) or not d > 0 else student_two_sided(s, d) for s, d in zip(t, df)], dtype="float64")
