"""Tail probabilities, evaluated on aggregated rows (one per test) as pandas UDFs."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

_TINY = 1e-300


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _continued_fraction(terms, limit: int = 10_000) -> float:
    """Modified Lentz evaluation of b0 + a1/(b1 + a2/(b2 + ...)); ``terms`` yields (a, b)."""
    _, b = next(terms)
    value = b or _TINY
    c, d = value, 0.0
    for _ in range(limit):
        a, b = next(terms)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        step = c * d
        value *= step
        if abs(step - 1.0) < 1e-16:
            break
    return value


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1.0 - front * total

    def terms():
        yield 0.0, x + 1 - a
        k = 1
        while True:
            yield -k * (k - a), x + 2 * k + 1 - a
            k += 1

    return front / _continued_fraction(terms())


def beta_regularized(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularized(b, a, 1 - x)
    front = math.exp(
        a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    )

    def terms():
        yield 0.0, 1.0
        m = 0
        while True:
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            m += 1
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return front / (a * _continued_fraction(terms()))


def t_two_sided(t: float, df: float) -> float:
    return beta_regularized(df / 2, 0.5, df / (df + t * t))


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else normal_two_sided(v))


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or pd.isna(n) or n <= 0 else t_two_sided(v, n) for v, n in zip(t, df)], dtype=float)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or pd.isna(n) or n <= 0 else chi2_upper(v, n) for v, n in zip(x, df)], dtype=float)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
