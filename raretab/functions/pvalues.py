"""Tail probabilities for the test statistics (T-3).

Spark SQL has no ``erfc`` or incomplete gamma, so p-values are a pandas UDF
applied to the aggregated test rows only (one row per feature), never to
data rows.  The chi-square tail for integer degrees of freedom uses the
closed forms

    even k:  Q = exp(-x/2) * sum_{i < k/2} (x/2)^i / i!
    odd  k:  Q = erfc(sqrt(x/2)) + exp(-x/2) * sum_{i=1}^{(k-1)/2} (x/2)^(i-1/2) / Gamma(i+1/2)

A rank test of a tiny sample without ties takes the exact null distribution of
U instead: the number of ways in which k of the m * n pairs are inversions is the
coefficient of q^k in prod_{i=1..m} (1 - q^(n+i)) / (1 - q^i).
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_two_sided(z: float) -> float:
    """P(|Z| >= z) for z >= 0 (used as 2 * sf(z)), capped at 1."""
    if z is None or math.isnan(z):
        return float("nan")
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def _log_sum(logs: list[float]) -> float:
    """log(sum(exp(l))) without overflow."""
    top = max(logs)
    return top + math.log(math.fsum(math.exp(x - top) for x in logs))


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution with integer dof ``k``.

    The closed-form sums are taken over logarithms of their terms, so large
    ``k`` and large ``x`` neither overflow nor lose the tail; NaN stays NaN."""
    if x is None or k is None or math.isnan(x):
        return float("nan")
    k = int(k)
    if k <= 0 or x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    h = x / 2.0
    log_h = math.log(h)
    if k % 2 == 0:
        return min(1.0, math.exp(_log_sum([i * log_h - math.lgamma(i + 1.0) for i in range(k // 2)]) - h))
    head = math.erfc(math.sqrt(h))
    if k == 1:
        return min(1.0, head)
    logs = [(i - 0.5) * log_h - math.lgamma(i + 0.5) for i in range(1, (k - 1) // 2 + 1)]
    return min(1.0, head + math.exp(_log_sum(logs) - h))


# Fixed value: the smaller class of a rank test with the exact distribution has at most this many rows.
EXACT_ROWS = 8
# Pairs (m * n) up to which that distribution is counted; beyond, the normal approximation stands.
EXACT_PAIRS = 1_000_000


@lru_cache(maxsize=512)
def _lower_tail(m: int, n: int) -> list[int]:
    """Arrangements of m and n rows with U <= k, for every k up to m * n / 2
    (exact integers; only the table of the smaller half is kept)."""
    top = m * n // 2
    ways = [1] + [0] * top
    for i in range(1, m + 1):
        for k in range(top, n + i - 1, -1):
            ways[k] -= ways[k - n - i]
        for k in range(i, top + 1):
            ways[k] += ways[k - i]
    return list(accumulate(ways))


def rank_two_sided(u: float, n0: int, n1: int) -> float:
    """Exact two-sided p of U in a sample without ties, capped at 1."""
    m, n = sorted((int(n0), int(n1)))
    least = int(min(u, m * n - u))
    # long tables are not worth keeping
    tail = (_lower_tail if m * n <= 10_000 else _lower_tail.__wrapped__)(m, n)
    return min(1.0, 2 * tail[least] / math.comb(m + n, m))


@F.pandas_udf(T.DoubleType())
def _p_rank(z: pd.Series, u: pd.Series, n0: pd.Series, n1: pd.Series, tied: pd.Series) -> pd.Series:
    def p(z, u, a, b, t):
        if pd.isna(z):
            return float("nan")
        if not t and min(a, b) <= EXACT_ROWS and a * b <= EXACT_PAIRS:
            return rank_two_sided(u, a, b)
        return normal_two_sided(float(z))

    return pd.Series([p(*row) for row in zip(z, u, n0, n1, tied)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _p_chi2(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(a), int(b)) if pd.notna(a) and pd.notna(b) else float("nan")
                      for a, b in zip(x, k)])


def p_from_chi2(stat: Column, dof: Column) -> Column:
    return _p_chi2(stat, dof)


def p_from_ranks(z: Column, u: Column, n0: Column, n1: Column, tied: Column) -> Column:
    """p of a rank test: exact for a tiny sample without ties, else from z."""
    return _p_rank(z, u, n0, n1, tied)
