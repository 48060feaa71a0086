"""Distribution functions in numpy, and as vectorised column functions (normal, t, incomplete beta, exact Wilcoxon)."""

from __future__ import annotations

import math
from itertools import product
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_STANDARD = NormalDist()
_erf = np.vectorize(math.erf, otypes=[float])
_ppf = np.vectorize(_STANDARD.inv_cdf, otypes=[float])


def normal_cdf(x) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x, dtype=float) / math.sqrt(2)))


def normal_ppf(p) -> np.ndarray:
    return _ppf(np.clip(np.asarray(p, dtype=float), 1e-12, 1 - 1e-12))


def _column(f, column):
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(f(x))

    return F.pandas_udf(run, "double")(column)


def normal_cdf_col(column):
    """The normal distribution function of a column, by Arrow batches."""
    return _column(normal_cdf, column)


def normal_ppf_col(column):
    """The normal quantile function of a column, by Arrow batches."""
    return _column(normal_ppf, column)


def lognormal_cdf_col(column, loc: float = 0.0, scale: float = 1.0):
    """The lognormal distribution function of a column, by Arrow batches; 0 for what is not positive."""
    return _column(lambda x: np.where(np.asarray(x) > 0, normal_cdf((np.log(np.maximum(np.asarray(x, dtype=float), 1e-300)) - loc) / scale), 0.0), column)


def lognormal_ppf_col(column, loc: float = 0.0, scale: float = 1.0):
    """The lognormal quantile function of a column, by Arrow batches."""
    return _column(lambda p: np.exp(loc + scale * normal_ppf(p)), column)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_cdf(t: float, df: float) -> float:
    p = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return 1 - p if t > 0 else p


def t_ppf(p: float, df: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def wilcoxon(differences: list[float]) -> tuple[float, float]:
    """Signed-rank statistic and two-sided p: exact up to 16 non-zero differences, else normal."""
    d = np.array([x for x in differences if x != 0])
    if not len(d):
        return 0.0, 1.0
    rank = pd.Series(np.abs(d)).rank().to_numpy()
    w = min(rank[d > 0].sum(), rank[d < 0].sum())
    if len(d) <= 16:
        sums = np.array([sum(r for r, s in zip(rank, signs, strict=True) if s) for signs in product((0, 1), repeat=len(d))])
        return float(w), float(min(1.0, 2 * np.mean(sums <= w + 1e-9)))
    n = len(d)
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return float(w), float(min(1.0, 2 * normal_cdf(z)))


def paired_t(a: list[float], b: list[float]) -> dict[str, float]:
    """Paired t-test: mean difference, t, p, Cohen's d and the 95 % interval."""
    d = np.asarray(a, dtype=float) - np.asarray(b, dtype=float)
    n, mean, sd = len(d), float(d.mean()), float(d.std(ddof=1)) if len(d) > 1 else 0.0
    if n < 2 or sd == 0:
        return {"mean_diff": mean, "t": 0.0, "p": 1.0 if mean == 0 else 0.0, "d": 0.0, "low": mean, "high": mean}
    t = mean / (sd / math.sqrt(n))
    half = t_ppf(0.975, n - 1) * sd / math.sqrt(n)
    return {"mean_diff": mean, "t": t, "p": 2 * (1 - t_cdf(abs(t), n - 1)), "d": mean / sd, "low": mean - half, "high": mean + half}


def bonferroni(p: list[float]) -> list[float]:
    return [min(1.0, x * len(p)) for x in p]
