"""Tail probabilities that SQL has no function for, as Arrow UDFs over the few rows of a test."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
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
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _udf(f):
    @F.pandas_udf("double")
    def over(x, y):
        import pandas as pd

        return pd.Series([None if a is None or b is None or a != a or b != b else f(float(a), float(b)) for a, b in zip(x, y)], dtype="float64")

    return over


def chi2_p(statistic: Column, dof: Column) -> Column:
    return _udf(lambda s, k: gamma_upper(k / 2, s / 2) if k > 0 else 1.0)(statistic, dof.cast("double"))


def normal_p(z: Column) -> Column:
    """Two-sided."""
    return _udf(lambda x, _: math.erfc(abs(x) / math.sqrt(2)))(z, F.lit(0.0))


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided."""
    return _udf(lambda x, k: beta_lower(k / 2, 0.5, k / (k + x * x)) if k > 0 else 1.0)(t, dof.cast("double"))


def hypergeometric_tail(k: int, drawn: int, marked: int, total: int) -> float:
    """Probability of at least k marked among those drawn."""
    lc = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1) if 0 <= r <= n else -math.inf
    return min(1.0, sum(math.exp(lc(marked, i) + lc(total - marked, drawn - i) - lc(total, drawn)) for i in range(k, min(drawn, marked) + 1)))
