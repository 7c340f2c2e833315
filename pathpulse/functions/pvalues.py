"""Tail probabilities for test statistics; applied to finished statistics, a row per feature."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_beta(a: float, b: float) -> float:
    """Logarithm of the beta function; Stirling differences keep its digits for large arguments."""
    large, small = max(a, b), min(a, b)
    if large < 1e4:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    total = large + small
    growth = (
        (large - 0.5) * math.log1p(small / large) + small * math.log(total) - small
        + (1 / total - 1 / large) / 12
    )
    return math.lgamma(small) - growth


def beta_tail(a: float, b: float, x: float, y: float) -> float:
    """Regularised incomplete beta function at x = 1 - y by its continued fraction."""
    if x <= 0 or y <= 0:
        return float(y <= 0)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, y, x)
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)
    front = math.exp(a * log_x + b * log_y - _log_beta(a, b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    total = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def _near_normal(t: float, df: float) -> float:
    """The normal limit of the two-sided Student probability with its first two corrections."""
    first = t * (t * t + 1) / 4
    second = t * (3 * t**6 - 7 * t**4 - 5 * t * t - 3) / 96
    return math.erfc(t / math.sqrt(2)) + 2 * math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * (first + second / df) / df


def student_two_sided(t: float, df: float) -> float:
    if pd.isna(t) or pd.isna(df) or df <= 0:
        return math.nan
    if not math.isfinite(t):
        return 0.0
    if df > 1e6 and t**4 < df / 1e3:
        return _near_normal(abs(t), df)
    return beta_tail(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))


def fisher_upper(f: float, d1: float, d2: float) -> float:
    if pd.isna(f) or pd.isna(d1) or pd.isna(d2) or d1 <= 0 or d2 <= 0:
        return math.nan
    if not math.isfinite(f):
        return 0.0
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def normal_two_sided(z: float) -> float:
    return math.nan if pd.isna(z) else math.erfc(abs(z) / math.sqrt(2))


#: So many counts are kept at most for an exact U probability; beyond that the limit law of the sum is as good.
MOST_COUNTS = 1 << 21


def _box_counts(k: int, m: int, u: int) -> np.ndarray:
    """How many ways k ranks among k + m give U = 0 … u, as whole numbers.

    The generating function is the product of (1 - q^(m+i)) / (1 - q^i): a difference, then running sums of stride i.
    """
    counts = np.zeros(u + 1, object)
    counts[0] = 1
    for i in range(1, k + 1):
        if m + i <= u:
            counts[m + i :] = counts[m + i :] - counts[: u + 1 - m - i]
        for start in range(min(i, u + 1)):
            counts[start::i] = np.add.accumulate(counts[start::i])
    return counts


def _uniform_sum(k: int, x: float) -> float:
    """Probability that k uniform numbers add up to x or less."""
    if x > k / 2:
        return 1 - _uniform_sum(k, k - x)
    return sum((-1) ** j * math.comb(k, j) * (x - j) ** k for j in range(int(max(x, 0)) + 1)) / math.factorial(k)


def rank_sum_two_sided(n1: float, n2: float, u: float) -> float:
    """Two-sided probability of a U statistic without ties, over all ways to deal out the ranks.

    Beyond ``MOST_COUNTS`` counts, which needs a sample of hundreds of thousands beside one of a few, the smaller
    sample's ranks are as good as uniform: their sum is taken at the exact mean and variance (error below 1e-9).
    """
    if any(pd.isna(v) for v in (n1, n2, u)) or min(n1, n2) < 1:
        return math.nan
    k, m = int(min(n1, n2)), int(max(n1, n2))
    low = int(min(u, k * m - u))
    if low < MOST_COUNTS:
        tail = int(_box_counts(k, m, low).sum()) / math.comb(k + m, k)
    else:
        tail = _uniform_sum(k, (low + 0.5 - k * m / 2) / math.sqrt(m * (m + k + 1)) + k / 2)
    return min(1.0, 2 * tail)


def _column(values: list[float]) -> pd.Series:
    return pd.Series([None if math.isnan(v) else v for v in values], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _column([student_two_sided(a, b) for a, b in zip(t, df)])


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _column([fisher_upper(a, b, c) for a, b, c in zip(f, d1, d2)])


@F.pandas_udf(T.DoubleType())
def z_p_value(z: pd.Series) -> pd.Series:
    return _column([normal_two_sided(v) for v in z])


@F.pandas_udf(T.DoubleType())
def rank_sum_p_value(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    return _column([rank_sum_two_sided(a, b, c) for a, b, c in zip(n1, n2, u)])
