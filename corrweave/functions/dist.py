"""Distributions, in numpy and the standard library: the tails that tests need, a whole column at a time."""

from __future__ import annotations

import functools
import math
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _plain(x: np.ndarray) -> np.ndarray | float:
    """A number for numbers, an array for arrays."""
    return float(x) if np.ndim(x) == 0 else x


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive x: Stirling's series from 10 on, smaller x shifted up."""
    y = np.array(x, float)
    shift = np.zeros_like(y)
    while (small := y < 10).any():
        shift = np.where(small, shift - np.log(np.where(small, y, 1.0)), shift)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / y + shift


def beta_inc(a, b, x):
    """Regularised incomplete beta by its continued fraction, for numbers or arrays."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inside = (x > 0) & (x < 1)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(inside, np.where(flip, 1 - x, x), 0.5)
    front = np.exp(p * np.log(z) + q * np.log1p(-z) - (log_gamma(p) + log_gamma(q) - log_gamma(p + q))) / p
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(z), 1 / away(1 - (p + q) * z / (p + 1))
    f = d.copy()
    for m in range(1, 1000):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / away(1 + num * d)
            c = away(1 + num / c)
            f = f * c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    out = np.where(flip, 1 - front * f, front * f)
    return _plain(np.where(inside, out, (x >= 1).astype(float)))


def t_two_sided(t, df):
    """Two-sided tail of Student's t, for numbers or arrays; NaN where either is missing or df is not positive."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    good = ~np.isnan(t) & (df > 0)
    safe_t, safe_df = np.where(good & np.isfinite(t), t, 0.0), np.where(good, df, 1.0)
    p = np.where(np.isinf(t), 0.0, beta_inc(safe_df / 2, 0.5, safe_df / (safe_df + safe_t * safe_t)))
    return _plain(np.where(good, p, np.nan))


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of an array: the series of erf below 2.5, the continued fraction beyond."""
    x = np.asarray(x, float)
    a = np.minimum(np.abs(np.where(np.isnan(x), 0.0, x)), 30.0)
    low = np.minimum(a, 2.5)
    term = total = low
    for k in range(1, 90):
        term = term * 2 * low * low / (2 * k + 1)
        total = total + term
    near = 1 - 2 / math.sqrt(math.pi) * np.exp(-low * low) * total
    high = np.maximum(a, 2.5)
    f = np.zeros_like(high)
    for k in range(120, 0, -1):
        f = k / (2 * high * high) / (1 + f)
    far = np.exp(-high * high) / (high * math.sqrt(math.pi)) / (1 + f)
    out = np.where(a < 2.5, near, far)
    return np.where(np.isnan(x), np.nan, np.where(x < 0, 2 - out, out))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """By bisection on the complementary error function; exact to rounding."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - normal_sf(mid) < p else (low, mid)
    return (low + high) / 2


def chi2_sf1(x: float) -> float:
    """Upper tail of chi-square with one degree."""
    return math.erfc(math.sqrt(x / 2)) if x > 0 else 1.0


def chi2_isf1(p: float) -> float:
    """Upper quantile of chi-square with one degree."""
    low, high = 0.0, 2000.0
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_sf1(mid) > p else (low, mid)
    return (low + high) / 2


@functools.lru_cache(maxsize=256)
def _rank_sum_counts(n0: int, n1: int) -> tuple[float, ...]:
    """Ways to reach each value of the rank-sum statistic."""
    ways = np.zeros((n0 + 1, n0 * n1 + 1))
    ways[0, 0] = 1
    for k in range(1, n0 + n1 + 1):
        for m in range(min(k, n0), 0, -1):
            shift = k - m
            if shift <= n0 * n1:
                ways[m, shift:] += ways[m - 1, : n0 * n1 + 1 - shift]
    return tuple(ways[n0])


def wilcoxon_tail(w, n0, n1, tie_sum) -> np.ndarray:
    """Two-sided p of rank-sum statistics, arrays alike: exact for samples below 50 without ties (``tie_sum``, the sum of t^3 - t over sizes of ties, is 0), else normal with tie and continuity correction."""
    w, n0, n1, ties = (np.atleast_1d(np.asarray(v, float)) for v in (w, n0, n1, tie_sum))
    out = np.full(len(w), np.nan)
    some = (n0 >= 1) & (n1 >= 1) & ~np.isnan(w)
    exact = some & (n0 < 50) & (n1 < 50) & (ties == 0)
    for a, b in {(int(x), int(y)) for x, y in zip(n0[exact], n1[exact], strict=True)}:
        mine = exact & (n0 == a) & (n1 == b)
        ways = np.array(_rank_sum_counts(a, b))
        upto = np.cumsum(ways)
        k = np.rint(w[mine]).astype(int)
        tail = np.where(w[mine] > a * b / 2, upto[-1] - np.where(k > 0, upto[np.maximum(k - 1, 0)], 0), upto[np.clip(k, 0, a * b)])
        out[mine] = np.minimum(2 * tail / upto[-1], 1.0)
    rest = some & ~exact
    n = n0 + n1
    with np.errstate(divide="ignore", invalid="ignore"):
        var = n0 * n1 / 12 * ((n + 1) - ties / (n * (n - 1)))
        z = w - n0 * n1 / 2
        z = (z - np.sign(z) * 0.5) / np.sqrt(var)
        out[rest] = np.where(var[rest] > 0, np.minimum(erfc(np.abs(z[rest]) / math.sqrt(2)), 1.0), np.nan)
    return out


def wilcoxon_p(w: float, n0: int, n1: int, tie_sizes: list[int] | None = None) -> float:
    """One statistic's p, from the sizes of its ties."""
    return float(wilcoxon_tail(w, n0, n1, sum(t**3 - t for t in tie_sizes or []))[0])


def pearson_p(r, n):
    """Two-sided p of correlations, for numbers or arrays; NaN below three rows."""
    r, n = np.broadcast_arrays(np.asarray(r, float), np.asarray(n, float))
    good = (n >= 3) & ~np.isnan(r)
    inside = good & (np.abs(r) < 1)
    safe = np.where(inside, r, 0.0)
    t = np.where(inside, safe * np.sqrt(np.where(good, n - 2, 1.0) / (1 - safe * safe)), np.inf)
    return _plain(np.where(good, t_two_sided(t, np.where(good, n - 2, 1.0)), np.nan))


@functools.lru_cache(maxsize=16)
def _spearman_exact(n: int) -> np.ndarray:
    """Sorted sums of squared rank differences over all orders; for n of 9 at most."""
    base = np.arange(n)
    return np.sort([((base - np.array(p)) ** 2).sum() for p in permutations(range(n))])


#: Coefficients of the Edgeworth series for the tail of the sum of squared rank differences.
_EDGEWORTH = (0.2274, 0.2531, 0.1745, 0.0758, 0.1033, 0.3932, 0.0879, 0.0151, 0.0072, 0.0831, 0.0131, 4.6e-4)


def _rank_difference_tail(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """P(S >= s) for sums of squared rank differences: exact for nine rows or fewer, else by the series."""
    cubes = n * (n * n - 1.0)
    out = np.zeros(len(s))
    for k in {int(v) for v in n[n <= 9]}:
        mine = n == k
        every = _spearman_exact(k)
        out[mine] = 1 - np.searchsorted(every, s[mine], "left") / len(every)
    c1, c2, c3, c4, c5, c6, c7, c8, c9, c10, c11, c12 = _EDGEWORTH
    big = n > 9
    b = 1.0 / n[big]
    x = (6 * (s[big] - 1) * b / (n[big] * n[big] - 1.0) - 1) * np.sqrt(1 / b - 1)
    y = x * x
    u = x * b * (c1 + b * (c2 + c3 * b) + y * (-c4 + b * (c5 + c6 * b) - y * b * (c7 + c8 * b - y * (c9 - c10 * b + y * b * (c11 - c12 * y)))))
    out[big] = np.clip(u / np.exp(y / 2) + 0.5 * erfc(x / math.sqrt(2)), 0.0, 1.0)
    return np.where(s <= 0, 1.0, np.where(s > cubes / 3, 0.0, out))


def spearman_tail(rho, n, ties) -> np.ndarray:
    """Two-sided p of rank correlations, arrays alike: by t with ties, else by the series (exact enumeration for nine rows or fewer)."""
    rho, n, ties = np.broadcast_arrays(np.atleast_1d(np.asarray(rho, float)), np.asarray(n, float), np.asarray(ties, bool))
    out = np.atleast_1d(pearson_p(rho, n)).copy()
    some = ~np.isnan(out) & ~ties
    r, m = rho[some], n[some]
    cubes = m * (m * m - 1.0)
    s = 2 * np.round(cubes * (1 - r) / 6 / 2)
    upper = s > cubes / 6
    tail = np.where(upper, _rank_difference_tail(s, m), 1 - _rank_difference_tail(s + 2, m))
    out[some] = np.minimum(2 * tail, 1.0)
    return out


def spearman_p(rho: float, n: int, ties: bool) -> float:
    return float(spearman_tail(rho, n, ties)[0])


def _numbers(*columns: pd.Series) -> list[np.ndarray]:
    return [pd.to_numeric(c).to_numpy(float, na_value=np.nan) for c in columns]


t_p_udf = F.pandas_udf(lambda t, df: pd.Series(np.atleast_1d(t_two_sided(*_numbers(t, df)))), T.DoubleType())
pearson_p_udf = F.pandas_udf(lambda r, n: pd.Series(np.atleast_1d(pearson_p(*_numbers(r, n)))), T.DoubleType())
spearman_p_udf = F.pandas_udf(lambda r, n, ties: pd.Series(spearman_tail(*_numbers(r, n), ties.fillna(False).to_numpy(bool))), T.DoubleType())
wilcoxon_p_udf = F.pandas_udf(lambda w, a, b, ties: pd.Series(wilcoxon_tail(*_numbers(w, a, b, ties))), T.DoubleType())
