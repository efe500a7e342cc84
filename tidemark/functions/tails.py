"""Upper tails of the usual test distributions, vectorised over Arrow batches, from continued fractions and series."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_TINY = 1e-300
_gammaln = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_gammaln(p + q) - _gammaln(p) - _gammaln(q) + p * np.log(z) + q * np.log1p(-z)) / p
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        f = d.copy()
        for m in range(1, 400):
            for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 + step * d, 1 + step / c
                d, c = 1 / np.where(np.abs(d) < _TINY, _TINY, d), np.where(np.abs(c) < _TINY, _TINY, c)
                f = f * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
    out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * f))
    return np.where(swap, 1 - out, out)


def gammaincc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(a * np.log(x) - x - _gammaln(a))
        term = total = 1 / a
        for n in range(1, 1000):
            term = term * x / (a + n)
            total = total + term
            if np.nanmax(np.where(x < a + 1, term / total, 0), initial=0) < 1e-16:
                break
        b = x + 1 - a
        c, d = np.full_like(x, 1 / _TINY), 1 / np.where(b == 0, _TINY, b)
        h = d.copy()
        for n in range(1, 1000):
            an, b = -n * (n - a), b + 2
            d, c = an * d + b, b + an / c
            d, c = 1 / np.where(np.abs(d) < _TINY, _TINY, d), np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
            if np.nanmax(np.where(x >= a + 1, np.abs(d * c - 1), 0), initial=0) < 1e-15:
                break
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h))


def kolmogorov_sf(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    k = np.arange(1, 101)[:, None]
    return np.where(x < 0.2, 1.0, np.clip(2 * ((-1.0) ** (k - 1) * np.exp(-2 * k**2 * np.atleast_1d(x) ** 2)).sum(0), 0, 1).reshape(x.shape))


def _column(fn, *names):
    return F.pandas_udf(fn, "double")(*(F.col(n).cast("double") for n in names))


def f_sf(stat: str, df1: str, df2: str):
    def run(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(betainc(b / 2, a / 2, b / (b + a * f)))

    return _column(run, stat, df1, df2)


def t_sf2(stat: str, df: str):
    def run(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(betainc(n / 2, np.full(len(n), 0.5), n / (n + t * t)))

    return _column(run, stat, df)


def chi2_sf(stat: str, df: str):
    def run(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(gammaincc(n / 2, x / 2))

    return _column(run, stat, df)


def normal_sf2(stat: str):
    def run(z: pd.Series) -> pd.Series:
        return pd.Series(_erfc(np.abs(z.to_numpy(float)) / math.sqrt(2)))

    return _column(run, stat)


def kolmogorov_exact(n1: int, n2: int, gap: int) -> float:
    """Probability that two samples of one law, without ties, differ somewhere by ``gap`` / lcm(n1, n2) or more.

    Orders of the pooled sample are lattice paths from (0, 0) to (n1, n2), all alike. A point's share is that of the paths
    to it that have left the band of smaller differences; a path comes to (i, j) by its last step from one of two points,
    with chances i and j out of i + j. Diagonals follow each other, so shares stay between 0 and 1 and nothing cancels.
    """
    g = math.gcd(n1, n2)
    a, b = n2 // g, n1 // g
    if gap <= 0:
        return 1.0
    share = np.zeros(n1 + 2)  # of the point with i - 1 steps in the first sample
    for s in range(1, n1 + n2 + 1):
        i = np.arange(max(0, s - n2), min(n1, s) + 1)
        left = share[i] * i / s + share[i + 1] * (s - i) / s
        share[i + 1] = np.where(np.abs(i * a - (s - i) * b) >= gap, 1.0, left)
        share[i[0]] = 0.0
    return float(share[n1 + 1])


def ks_exact(stat: str, n1: str, n2: str, most: int):
    """The exact p-value while neither sample has more than ``most`` rows, that of the limit law beyond it."""

    def run(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out, known = [], {}
        limit = kolmogorov_sf((np.sqrt(a * b / (a + b)) * d).to_numpy(float))
        for x, n, m, p in zip(d, a, b, limit):
            if np.isnan(x) or max(n, m) > most:
                out.append(p)
                continue
            key = int(n), int(m), round(x * math.lcm(int(n), int(m)))
            if key not in known:
                known[key] = kolmogorov_exact(*key)
            out.append(known[key])
        return pd.Series(out, dtype=float)

    return _column(run, stat, n1, n2)


def normal_quantile(p: str):
    inverse = NormalDist().inv_cdf

    def run(x: pd.Series) -> pd.Series:
        return pd.Series([inverse(v) if 0 < v < 1 else math.nan for v in x], dtype=float)

    return _column(run, p)


def ks_sf(stat: str, n1: str, n2: str):
    def run(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(kolmogorov_sf((np.sqrt(a * b / (a + b)) * d).to_numpy(float)))

    return _column(run, stat, n1, n2)
