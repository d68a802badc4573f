"""Tail probabilities for test statistics.

These run on one row per test, after all data has been aggregated by Spark.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT_KS_ROWS = 10_000
EXACT_PATHS = 4_000_000
EXACT_RANKS = 50
EXACT_U = 8


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def two_sided_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def kolmogorov_limit(x: float) -> float:
    """P(K > x) of the limiting Kolmogorov distribution."""
    if x <= 0:
        return 1.0
    if x < 0.3:
        # The dual series converges fast where the usual one does not.
        k = np.arange(1, 20)
        return 1.0 - math.sqrt(2 * math.pi) / x * float(np.sum(np.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x))))
    k = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x)))))


def ks_one_sample_p(d: float, n: int) -> float:
    """P(D_n >= d): the matrix method of Marsaglia, Tsang and Wang (2003), the limit law for large n."""
    if n > EXACT_KS_ROWS:
        return kolmogorov_limit(d * math.sqrt(n))
    if d >= 1:
        return 0.0
    s = d * d * n
    if s > 7.24 or (s > 3.76 and n > 99):
        return min(1.0, 2 * math.exp(-(2.000071 + 0.331 / math.sqrt(n) + 1.409 / n) * s))
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    grid = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    mat = (grid >= 0).astype(float)
    powers = h ** np.arange(1, m + 1)
    mat[:, 0] -= powers
    mat[m - 1, :] -= powers[::-1]
    mat[m - 1, 0] += (2 * h - 1) ** m if 2 * h - 1 > 0 else 0.0
    logs = np.array([math.lgamma(i + 1) for i in range(m + 1)])
    mat *= np.where(grid > 0, np.exp(-logs[np.clip(grid, 0, m)]), 1.0)
    result, shift, base, base_shift, left = np.eye(m), 0, mat, 0, n
    while left:
        if left & 1:
            result, shift = result @ base, shift + base_shift
        base, base_shift = base @ base, base_shift * 2
        left >>= 1
        if base[k - 1, k - 1] > 1e140:
            base, base_shift = base * 1e-140, base_shift + 140
        if result[k - 1, k - 1] > 1e140:
            result, shift = result * 1e-140, shift + 140
    log_p = math.log(max(result[k - 1, k - 1], 1e-300)) + shift * math.log(10) + math.lgamma(n + 1) - n * math.log(n)
    return float(min(1.0, max(0.0, 1.0 - math.exp(log_p))))


def ks_two_sample_p(d: float, n1: int, n2: int) -> float:
    """P(D >= d) by counting lattice paths for moderate sizes, else the one-sample law at the effective size."""
    if n1 * n2 > EXACT_PATHS:
        return ks_one_sample_p(d, max(1, round(n1 * n2 / (n1 + n2))))
    limit = d - 1e-12
    j = np.arange(n2 + 1)
    # Probability of staying strictly below the bound, moving along one sample at a time.
    row = np.cumprod(np.where(j / n2 < limit, 1.0, 0.0))
    log_scale = 0.0
    for i in range(1, n1 + 1):
        inside = np.abs(i / n1 - j / n2) < limit
        row = _paths(row, inside)
        top = row.max()
        if top == 0:
            return 1.0
        row, log_scale = row / top, log_scale + math.log(top)
    if row[-1] <= 0:
        return 1.0
    total = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
    return float(min(1.0, max(0.0, 1.0 - math.exp(math.log(row[-1]) + log_scale - total))))


def ks_one_way_p(d: float, n1: int, n2: int) -> float:
    """P(D+ >= d) for the largest excess of one distribution over the other: lattice paths for moderate sizes, else Hodges' limit."""
    if d <= 0:
        return 1.0
    if n1 * n2 > EXACT_PATHS:
        n1, n2 = max(n1, n2), min(n1, n2)
        z = math.sqrt(n1 * n2 / (n1 + n2)) * d
        return float(min(1.0, max(0.0, math.exp(-2 * z * z - 2 * z * (n1 + 2 * n2) / math.sqrt(n1 * n2 * (n1 + n2)) / 3))))
    limit = d - 1e-12
    j = np.arange(n2 + 1)
    row, log_scale = np.ones(n2 + 1), 0.0
    for i in range(1, n1 + 1):
        row = _paths(row, i / n1 - j / n2 < limit)
        top = row.max()
        if top == 0:
            return 1.0
        row, log_scale = row / top, log_scale + math.log(top)
    if row[-1] <= 0:
        return 1.0
    total = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
    return float(min(1.0, max(0.0, 1.0 - math.exp(math.log(row[-1]) + log_scale - total))))


def _paths(row: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Paths reaching each cell from below or from the left inside the allowed band (a contiguous stretch)."""
    out = np.zeros_like(row)
    at = np.flatnonzero(inside)
    if at.size:
        out[at] = np.cumsum(row[at])
    return out


def signed_rank_p(v_plus: float, n: int, tie_term: float, alternative: str = "two-sided") -> float:
    """Wilcoxon signed-rank tail: exact for small n without ties, else normal with tie correction."""
    if n < 1:
        return math.nan
    total = n * (n + 1) / 2
    if n <= EXACT_RANKS and tie_term == 0:
        ways = np.zeros(int(total) + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        ways /= ways.sum()
        at_most = float(ways[: int(math.floor(v_plus)) + 1].sum())
        at_least = float(ways[int(math.ceil(v_plus)):].sum())
        if alternative == "greater":
            return at_least
        if alternative == "less":
            return at_most
        return min(1.0, 2 * min(at_most, at_least))
    se = math.sqrt(max(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48, 1e-300))
    return _one_or_two((v_plus - total / 2) / se, alternative)


def _one_or_two(z: float, alternative: str) -> float:
    if alternative == "greater":
        return 0.5 * math.erfc(z / math.sqrt(2))
    if alternative == "less":
        return 0.5 * math.erfc(-z / math.sqrt(2))
    return two_sided_normal(z)


def rank_sum_p(u: float, n1: int, n2: int, tie_term: float) -> float:
    """Two-sided Mann-Whitney tail: exact for a small sample without ties, else normal with continuity and ties."""
    if n1 < 1 or n2 < 1:
        return math.nan
    upper = max(u, n1 * n2 - u)
    if tie_term == 0 and min(n1, n2) <= EXACT_U:
        counts = _u_counts(min(n1, n2), max(n1, n2))
        return float(min(1.0, 2 * counts[int(math.ceil(upper)):].sum() / counts.sum()))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - tie_term / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, two_sided_normal(max(0.0, upper - n1 * n2 / 2 - 0.5) / math.sqrt(var)))


def _u_counts(small: int, large: int) -> np.ndarray:
    """Number of arrangements for each U: coefficients of the Gaussian binomial."""
    size = small * large + 1
    out = np.zeros(size)
    out[0] = 1.0
    for k in range(1, small + 1):
        top, bottom = large + k, k
        shifted = out.copy()
        shifted[top:] -= out[:-top] if top < size else 0
        for i in range(bottom, size):
            shifted[i] += shifted[i - bottom]
        out = shifted
    return out


def _column(fn, *cols: Column) -> Column:
    @F.pandas_udf("double")
    def tail(rows: pd.DataFrame) -> pd.Series:
        values = rows.itertuples(index=False, name=None)
        return pd.Series([None if any(v is None or v != v for v in r) else fn(*r) for r in values], dtype="float64")
    return tail(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]))


def ks_one_sample(d: Column, n: Column) -> Column:
    return _column(lambda a, b: ks_one_sample_p(a, int(b)), d, n)


def ks_two_sample(d: Column, n1: Column, n2: Column) -> Column:
    return _column(lambda a, b, c: ks_two_sample_p(a, int(b), int(c)), d, n1, n2)


def ks_one_way(d: Column, n1: Column, n2: Column) -> Column:
    return _column(lambda a, b, c: ks_one_way_p(a, int(b), int(c)), d, n1, n2)


def signed_rank(v: Column, n: Column, ties: Column, alternative: str = "two-sided") -> Column:
    return _column(lambda a, b, c: signed_rank_p(a, int(b), c, alternative), v, n, ties)


def rank_sum(u: Column, n1: Column, n2: Column, ties: Column) -> Column:
    return _column(lambda a, b, c, d: rank_sum_p(a, int(b), int(c), d), u, n1, n2, ties)


def normal_two_sided(z: Column) -> Column:
    return _column(two_sided_normal, z)


def chi_square_upper(x: Column, df: int) -> Column:
    return _column(lambda v: chi_square_p(v, df), x)


def chi_square_p(x: float, df: int) -> float:
    """Upper tail of the chi-square law: regularised incomplete gamma by series or continued fraction."""
    if x <= 0:
        return 1.0
    a, y = df / 2.0, x / 2.0
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = total = 1.0 / a
        for i in range(1, 1000):
            term *= y / (a + i)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1.0 - front * total)
    b = y + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h
