"""Pair copulas and C-vines fitted from counts on grids of ranks.

For each pair of columns the rows are counted in GRID x GRID cells of their pseudo-observations; Kendall's tau and the
likelihood of every family come from these counts, whose number does not grow with the rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import normal_cdf, normal_ppf, t_cdf, t_ppf

GRID = 40
#: Families by the name of a set.
FAMILIES = {"gaussian": ("gaussian",), "student": ("student",), "archimedean": ("clayton", "gumbel", "frank", "joe"), "all": ("gaussian", "student", "clayton", "gumbel", "frank", "joe")}
DEGREES = (3, 6, 12)  # of freedom that are tried for a student pair
#: Pairs whose tau is nearer to 0 are independent.
LEAST_TAU = 0.01


@lru_cache(maxsize=16)
def _t_table(df: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.concatenate([np.geomspace(1e-9, 1e-3, 60), np.linspace(2e-3, 0.5, 250)])
    x = np.array([t_ppf(float(q), df) for q in p])
    return np.concatenate([p, 1 - p[-2::-1]]), np.concatenate([x, -x[-2::-1]])


def _student_cdf(x: np.ndarray, df: int) -> np.ndarray:
    p, q = _t_table(df)
    return np.interp(x, q, p)


def _student_ppf(u: np.ndarray, df: int) -> np.ndarray:
    p, q = _t_table(df)
    return np.interp(u, p, q)


def conditional(family: str, theta: float, u: np.ndarray, v: np.ndarray, df: int = 0) -> np.ndarray:
    """The distribution of the first variable at u, given that the second is v."""
    u, v = np.clip(u, 1e-9, 1 - 1e-9), np.clip(v, 1e-9, 1 - 1e-9)
    if family == "indep":
        return u + 0 * v
    if family == "gaussian":
        return normal_cdf((normal_ppf(u) - theta * normal_ppf(v)) / math.sqrt(1 - theta * theta))
    if family == "student":
        x, y = _student_ppf(u, df), _student_ppf(v, df)
        return _student_cdf((x - theta * y) / np.sqrt((df + y * y) * (1 - theta * theta) / (df + 1)), df + 1)
    if family == "clayton":
        return np.exp(-(theta + 1) * np.log(v) - (1 + 1 / theta) * np.log(u**-theta + v**-theta - 1))
    if family == "gumbel":
        x, y = -np.log(u), -np.log(v)
        both = x**theta + y**theta
        return np.exp(-(both ** (1 / theta))) / v * y ** (theta - 1) * both ** (1 / theta - 1)
    if family == "frank":
        a, b = np.expm1(-theta * u), np.expm1(-theta * v)
        return np.exp(-theta * v) * a / (math.expm1(-theta) + a * b)
    if family == "joe":
        a, b = (1 - u) ** theta, (1 - v) ** theta
        return (1 - v) ** (theta - 1) * (1 - a) * (a + b - a * b) ** (1 / theta - 1)
    raise ValueError(f"unknown family {family!r}")


def tau_of(family: str, theta: float) -> float:
    """Kendall's tau of a family of one parameter."""
    if family in ("gaussian", "student"):
        return 2 / math.pi * math.asin(theta)
    if family == "clayton":
        return theta / (theta + 2)
    if family == "gumbel":
        return 1 - 1 / theta
    if family == "joe":
        return 1 - 4 * sum(1 / (k * (theta * k + 2) * (theta * (k - 1) + 2)) for k in range(1, 400))
    if family == "frank":
        x = (np.arange(2000) + 0.5) / 2000 * theta
        return 1 - 4 / theta * (1 - float(np.mean(x / np.expm1(x))))
    raise ValueError(f"unknown family {family!r}")


def theta_of(family: str, tau: float) -> float:
    """The parameter at which a family has a positive tau, by bisection."""
    if family in ("gaussian", "student"):
        return math.sin(math.pi * min(tau, 0.99) / 2)
    low, high = {"clayton": (1e-4, 100.0), "frank": (1e-3, 200.0)}.get(family, (1.0001, 100.0))
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tau_of(family, mid) < tau else (low, mid)
    return (low + high) / 2


def tail_dependence(family: str, theta: float, df: float | None = None) -> tuple[float, float]:
    """Lower and upper tail dependence of a pair copula."""
    if family == "clayton":
        return (2 ** (-1 / theta) if theta > 0 else 0.0, 0.0)
    if family in ("gumbel", "joe"):
        return (0.0, 2 - 2 ** (1 / theta))
    if family == "student":
        x = 2 * t_cdf(-math.sqrt((df + 1) * (1 - theta) / (1 + theta)), df + 1)
        return (x, x)
    if family in ("gaussian", "frank", "indep"):
        return (0.0, 0.0)
    raise ValueError(f"unknown family {family!r}")


def grid_tau(n: np.ndarray) -> float:
    """Kendall's tau-a of counts on a grid, pairs within a row or column of cells half way."""
    upper = lambda m: np.cumsum(np.cumsum(m[::-1, ::-1], 0), 1)[::-1, ::-1]
    after = np.zeros_like(n)
    after[:-1, :-1] = upper(n)[1:, 1:]
    against = np.zeros_like(n)
    against[:-1, 1:] = upper(n[:, ::-1])[1:, 1:][:, ::-1]
    more, less = float((n * after).sum()), float((n * against).sum())
    return (more - less) / (more + less) if more + less else 0.0


class Pair:
    """A fitted pair copula; families without negative dependence see 1 - v for negative tau."""

    def __init__(self, counts: np.ndarray, families: tuple[str, ...]):
        n = counts.astype(float)
        self.tau = grid_tau(n)
        self.family, self.theta, self.df, self.turned = "indep", 0.0, 0, self.tau < 0
        edge, middle = np.arange(GRID + 1) / GRID, (np.arange(GRID) + 0.5) / GRID
        if self.turned:
            n = n[:, ::-1]
        best = 0.0  # the likelihood of independence is that of equal cells
        size = min(abs(self.tau), 0.95)
        for family in families if size >= LEAST_TAU else ():
            for df in DEGREES if family == "student" else (0,):
                theta = theta_of(family, size)
                with np.errstate(all="ignore"):  # a family that overflows at this tau does not fit
                    p = np.diff(conditional(family, theta, edge[:, None], middle[None, :], df), axis=0) * GRID
                fit = float((n * np.log(np.maximum(p, 1e-12))).sum()) - (2 if family == "student" else 1)
                if fit > best:
                    best, self.family, self.theta, self.df = fit, family, theta, df
        if self.family == "indep":
            self.turned = False

    def given(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return conditional(self.family, self.theta, u, 1 - v if self.turned else v, self.df)

    def draw(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The u for which given(u, v) is w, by bisection."""
        if self.family == "indep":
            return w
        low, high = np.zeros(len(w)), np.ones(len(w))
        for _ in range(34):
            mid = (low + high) / 2
            less = self.given(mid, v) < w
            low, high = np.where(less, mid, low), np.where(less, high, mid)
        return (low + high) / 2

    def report(self) -> dict:
        low, high = (0.0, 0.0) if self.turned else tail_dependence(self.family, self.theta, self.df)
        return {"family": self.family, "theta": -self.theta if self.turned else self.theta, "tau": self.tau, "lower": low, "upper": high}


def pair_counts(u: DataFrame, columns: list[str]) -> dict[tuple[int, int], np.ndarray]:
    """Rows by cell for each pair (i, j), i < j, of columns that hold numbers from 0 to 1: GRID^2 counts a pair."""
    cell = {c: F.least(F.lit(GRID - 1), F.floor(F.col(c) * GRID)).cast("int") for c in columns}
    pairs = [(i, j) for j in range(len(columns)) for i in range(j)]
    if not pairs:
        return {}
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), cell[columns[i]].alias("a"), cell[columns[j]].alias("b")) for i, j in pairs]))
    out = {p: np.zeros((GRID, GRID)) for p in pairs}
    for r in u.select(each.alias("e")).groupBy("e.i", "e.j", "e.a", "e.b").count().collect():
        out[r[0], r[1]][r[2], r[3]] = r[4]
    return out


class CVine:
    """A C-vine on columns of pseudo-observations; the root of each tree is the column of largest summed |tau|."""

    def __init__(self, u: DataFrame, columns: list[str], families: tuple[str, ...], trees: int | None = None):
        self.columns, self.order, self.pairs = columns, [], {}
        rest, shape = list(range(len(columns))), ", ".join(f"`{c}` double" for c in columns)
        for tree in range(len(columns)):
            counts = pair_counts(u, columns) if len(rest) > 1 and (trees is None or tree < trees) else {}
            tau = {p: abs(grid_tau(n)) for p, n in counts.items() if p[0] in rest and p[1] in rest}
            root = max(rest, key=lambda c: (sum(t for p, t in tau.items() if c in p), -c)) if tau else rest[0]
            rest.remove(root)
            self.order.append(root)
            own = {}
            for j in rest if tau else ():
                n = counts[min(root, j), max(root, j)]
                own[j] = self.pairs[tree, j] = Pair(n if j < root else n.T, families)
            if own and len(rest) > 1:

                def step(batches, own=own, root=root):
                    for b in batches:
                        v = b[columns[root]].to_numpy()
                        yield pd.DataFrame({c: own[k].given(b[c].to_numpy(), v) if k in own else b[c] for k, c in enumerate(columns)})

                u = u.mapInPandas(step, shape)

    def draw(self, rng, n: int) -> np.ndarray:
        """Rows of uniform numbers, by columns, with the vine's dependence."""
        w = rng.uniform(1e-9, 1 - 1e-9, size=(n, len(self.columns)))
        out, given = np.empty_like(w), {}
        for place, j in enumerate(self.order):
            x = w[:, place]
            for tree in range(place - 1, -1, -1):
                if (tree, j) in self.pairs:
                    x = self.pairs[tree, j].draw(x, given[tree])
            out[:, j] = x
            for tree in range(place):
                if (tree, j) in self.pairs:
                    x = self.pairs[tree, j].given(x, given[tree])
            given[place] = x
        return out

    def report(self) -> list[dict]:
        """Pairs of all trees with their family, tau and tail dependence."""
        return [{"tree": t + 1, "pair": f"{self.columns[self.order[t]]} x {self.columns[j]}", **p.report()} for (t, j), p in self.pairs.items()]
