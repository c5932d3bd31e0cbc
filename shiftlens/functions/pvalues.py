"""Tail probabilities for summary rows (one row per hypothesis, never per fact)."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_EPS = 1e-15
_LARGE_DF = 1e6


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Modified Lentz evaluation of the incomplete beta continued fraction."""
    front = 1.0
    ratio = 1.0 - (a + b) * x / (a + 1.0)
    ratio = 1.0 / (ratio if abs(ratio) > _TINY else _TINY)
    value = ratio
    for m in range(1, 20000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for term in (even, odd):
            ratio = 1.0 + term * ratio
            ratio = 1.0 / (ratio if abs(ratio) > _TINY else _TINY)
            front = 1.0 + term / front
            front = front if abs(front) > _TINY else _TINY
            value *= ratio * front
        if abs(ratio * front - 1.0) < _EPS:
            return value
    raise ArithmeticError("incomplete beta did not settle")


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_scale = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_scale) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_scale) * _beta_fraction(b, a, 1.0 - x) / b


def incomplete_gamma_upper(a: float, x: float) -> float:
    if x <= 0.0:
        return 1.0
    log_scale = a * math.log(x) - x - math.lgamma(a)
    limit = 1000 + int(20 * math.sqrt(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        for n in range(1, limit):
            term *= x / (a + n)
            total += term
            if term < total * _EPS:
                break
        return 1.0 - total * math.exp(log_scale)
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    value = d
    for n in range(1, limit):
        weight = -n * (n - a)
        b += 2.0
        d = weight * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + weight / c
        c = c if abs(c) > _TINY else _TINY
        value *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return math.exp(log_scale) * value


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def student_t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    if df > _LARGE_DF:
        scale = (8.0 * df + 1.0) / (8.0 * df + 3.0)
        return normal_two_sided(scale * math.sqrt(df * math.log1p(t * t / df)))
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def chi_square_upper(x: float, df: float) -> float:
    return incomplete_gamma_upper(df / 2.0, x / 2.0)


def _clamped(value: float) -> float:
    return min(1.0, max(0.0, value))


def _rows(function, *columns: pd.Series) -> pd.Series:
    out = [
        None if any(pd.isna(v) for v in row) else _clamped(function(*row))
        for row in zip(*columns, strict=True)
    ]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def student_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(student_t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(chi_square_upper, x, df)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _rows(normal_two_sided, z)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
