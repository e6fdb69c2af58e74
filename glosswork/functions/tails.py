"""Tail probabilities for small result tables, in Arrow batches: Spark has no erfc, incomplete gamma or log gamma."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """The upper tail of chi squared: a series below df + 2, a continued fraction above."""
    if df <= 0 or x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for k in range(1, 10_000):
        f = k * (a - k)
        b += 2
        d, c = 1 / (b + f * d), b + f / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * h


def fisher(a: int, b: int, c: int, d: int, most: int = 30_000) -> float:
    """Two-sided p of a table of two by two: the sum of all tables as likely or less; beyond `most` tables the test of two shares by the normal law."""
    n, row, column = a + b + c + d, a + b, a + c
    if n == 0:
        return 1.0
    low, high = max(0, row + column - n), min(row, column)
    if high - low > most:
        p = column / n
        spread = math.sqrt(p * (1 - p) * (1 / row + 1 / (n - row)))
        return 2 * normal_tail(abs(a / row - c / (n - row)) / spread) if spread else 1.0
    g = math.lgamma

    def log_p(x: int) -> float:
        return g(row + 1) - g(x + 1) - g(row - x + 1) + g(n - row + 1) - g(column - x + 1) - g(n - row - column + x + 1) - g(n + 1) + g(column + 1) + g(n - column + 1)

    seen = log_p(a)
    return min(1.0, sum(math.exp(p) for p in map(log_p, range(low, high + 1)) if p <= seen + 1e-7))


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else 2 * normal_tail(abs(v)))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else chi2_tail(float(a), int(b)) for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)], dtype="float64")
