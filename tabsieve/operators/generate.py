"""Synthetic rows from copulas.

Marginals and correlations are aggregates; their size depends on the columns (and, for categories, their values) only.
Rows are drawn by spark.range and mapInArrow, each partition from a generator seeded by (seed, partition).
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distributions import normal_cdf, normal_ppf
from . import vine
from .frames import quantiles, where_filters
from .vine import tail_dependence

log = logging.getLogger(__name__)


def numeric_marginals(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, kind, loc, scale, low, high, median): 'lognormal' for positive columns of skewness over 1, else 'normal'."""
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    median = quantiles(df, columns, [0.5])
    parts = []
    for c in columns:
        v = F.when(x[c] > 0, F.ln(F.when(x[c] > 0, x[c])))
        parts.append(F.struct(F.lit(c).alias("col"), F.avg(x[c]).alias("m"), F.stddev_pop(x[c]).alias("sd"), F.coalesce(F.skewness(x[c]), F.lit(0.0)).alias("skew"), F.min(x[c]).alias("low"), F.max(x[c]).alias("high"), F.lit(median[c][0] if median[c] else None).cast("double").alias("median"), F.avg(v).alias("lm"), F.stddev_pop(v).alias("ls")))
    rows = df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    log_ = (F.col("skew") > 1) & (F.col("low") > 0)
    scale = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return rows.select("col", F.when(log_, "lognormal").otherwise("normal").alias("kind"), F.when(log_, F.col("lm")).otherwise(F.col("m")).alias("loc"), F.when(log_, F.col("ls")).otherwise(scale).alias("scale"), "low", "high", "median")


def categorical_marginal(df: DataFrame, column: str) -> DataFrame:
    """(value, p, cum, mid): shares by descending frequency (ties by value), running sums, and their midpoints."""
    from pyspark.sql import Window

    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    # A row a category: the window runs over distinct values only.
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "value").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    n = n.withColumn("p", p).withColumn("cum", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(F.lit(0))))
    return n.select("value", "p", "cum", (F.col("cum") - F.col("p") / 2).alias("mid"))


class BaseGenerator:
    """fit() on a table, generate() rows with a running syn_id."""

    def __init__(self, verbose: bool = False):
        self.fitted, self.made, self.verbose = False, 0, verbose

    def fit(self, df: DataFrame) -> BaseGenerator:
        self.schema = df.schema
        self.spark = df.sparkSession
        self._fit(df)
        self.fitted = True
        return self

    def generate(self, n: int, filters: dict | None = None, seed: int | None = None) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("fit() first")
        shape = T.StructType([T.StructField("syn_id", T.StringType()), *self.schema.fields])
        if n <= 0:
            return self.spark.createDataFrame([], shape)
        out, unknown = self._generate(n, filters or {}, 42 if seed is None else seed)
        if unknown:
            log.warning("filters match no column: %s", unknown)
        first = self.made
        self.made += n
        out = out.select(F.concat(F.lit("SYN-"), (F.monotonically_increasing_id() + first + 1).cast("string")).alias("syn_id"), *[self._cast(f) for f in self.schema.fields])
        return out

    @staticmethod
    def _cast(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            return F.round(c.cast("double"), 0).cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, T.BooleanType):
            return (c.cast("string") == "true").alias(f.name)
        return c.cast(f.dataType).alias(f.name)


class GaussianCopula(BaseGenerator):
    """Marginals joined by a Gaussian copula; prior_weight shrinks normal means and deviations to a prior."""

    def __init__(self, prior: dict[str, tuple[float, float]] | None = None, prior_weight: float = 0.0, **kw):
        super().__init__(**kw)
        self.prior, self.prior_weight = prior or {}, prior_weight

    def _fit(self, df: DataFrame) -> None:
        self.numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        self.labels = [f.name for f in df.schema.fields if f.name not in self.numbers]
        self.marginals = {r["col"]: r.asDict() for r in numeric_marginals(df, self.numbers).collect()} if self.numbers else {}
        n = df.count()
        for c, (m, s) in self.prior.items():
            if c in self.marginals and self.marginals[c]["kind"] == "normal":
                w = self.prior_weight / (self.prior_weight + n) if n else 1.0
                mg = self.marginals[c]
                mg["loc"], mg["scale"] = (1 - w) * mg["loc"] + w * m, math.sqrt((1 - w) * mg["scale"] ** 2 + w * s**2)
        self.shares = {c: categorical_marginal(df, c).toPandas() for c in self.labels}  # a row a category
        columns = [*self.numbers, *self.labels]
        self.columns = columns
        me = self._bare()

        def normal_scores(batches):
            for b in batches:
                yield pd.DataFrame({c: normal_ppf(np.clip(me._ranks(c, b[c].astype(float)) if c in me.marginals else me._midpoints(c, b[c]), 1e-6, 1 - 1e-6)) for c in b.columns})

        d = len(columns)
        text = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in self.numbers], *[F.col(f"`{c}`").cast("string").alias(c) for c in self.labels])
        z = text.mapInPandas(normal_scores, ", ".join(f"`{c}` double" for c in columns))
        pairs = [(i, j) for i in range(d) for j in range(i)]
        row = z.agg(F.lit(0), *[F.covar_pop(columns[i], columns[j]) for i, j in pairs], *[F.stddev_pop(c) for c in columns]).first()[1:]
        sd = row[len(pairs) :]
        r = np.eye(d)
        for (i, j), cov in zip(pairs, row, strict=False):
            r[i, j] = r[j, i] = cov / (sd[i] * sd[j]) if cov is not None and sd[i] and sd[j] else 0.0
        self.correlation = self._positive(r)

    def _bare(self) -> GaussianCopula:
        """A copy without the session, for tasks."""
        out = type(self).__new__(type(self))
        out.__dict__.update({k: v for k, v in self.__dict__.items() if k not in ("spark", "schema")})
        return out

    def _ranks(self, column: str, x: pd.Series) -> np.ndarray:
        """Values of the fitted distribution function; unknown ones stand at the median."""
        m = self.marginals[column]
        x = x.fillna(m["median"] if m["median"] is not None else 0.0)
        z = (np.log(np.maximum(x, 1e-300)) if m["kind"] == "lognormal" else x) - (m["loc"] or 0.0)
        return normal_cdf(z / (m["scale"] or 1.0))

    def _midpoints(self, column: str, x: pd.Series) -> np.ndarray:
        mid = dict(zip(self.shares[column]["value"], self.shares[column]["mid"], strict=True))
        return x.astype(object).map(lambda v: mid.get(v, 0.5)).to_numpy(dtype=float)

    @staticmethod
    def _positive(r: np.ndarray) -> np.ndarray:
        r = np.nan_to_num(r) + 1e-10 * np.eye(len(r))
        low = np.linalg.eigvalsh(r).min() if len(r) else 1.0
        return r + (1e-8 - low) * np.eye(len(r)) if low < 1e-8 else r

    def marginal_kinds(self) -> dict[str, str]:
        return {**{c: m["kind"] for c, m in self.marginals.items()}, **dict.fromkeys(self.labels, "categorical")}

    def correlation_matrix(self) -> pd.DataFrame:
        return pd.DataFrame(self.correlation, index=self.columns, columns=self.columns)

    def _draw(self, rng, n: int) -> np.ndarray:
        try:
            root = np.linalg.cholesky(self.correlation)
        except np.linalg.LinAlgError:
            log.warning("correlations are not positive definite; columns are drawn independently")
            root = np.eye(len(self.columns))
        return normal_cdf(rng.normal(size=(n, len(self.columns))) @ root.T)

    def _values(self, u: np.ndarray) -> dict[str, object]:
        out: dict[str, object] = {}
        for k, c in enumerate(self.columns):
            if c in self.marginals:
                m = self.marginals[c]
                if m["low"] is None:
                    out[c] = np.full(len(u), np.nan)
                    continue
                x = (m["loc"] or 0.0) + (m["scale"] or 0.0) * normal_ppf(np.clip(u[:, k], 1e-6, 1 - 1e-6))
                out[c] = np.clip(np.exp(np.minimum(x, 700)) if m["kind"] == "lognormal" else x, m["low"], m["high"])
            else:
                s = self.shares[c]
                at = np.minimum(np.searchsorted(s["cum"].to_numpy(), u[:, k], side="left"), max(len(s) - 1, 0))
                out[c] = s["value"].to_numpy(dtype=object)[at] if len(s) else np.full(len(u), None)
        return out

    def _generate(self, n: int, filters: dict, seed: int) -> tuple[DataFrame, list[str]]:
        spark, g = self.spark, self._bare()
        shape = ", ".join(f"`{c}` {'double' if c in self.marginals else 'string'}" for c in self.columns)

        def rows(first: int, count: int) -> DataFrame:
            parts = max(1, min(200, count // 50_000 + 1))

            def make(batches):
                for b in batches:
                    ids = b["id"].to_numpy()
                    if len(ids):
                        rng = np.random.default_rng([seed, int(ids[0])])
                        yield pd.DataFrame(g._values(g._draw(rng, len(ids))))

            return spark.range(first, first + count, 1, parts).mapInPandas(make, shape)

        if not filters:
            return rows(0, n), []
        batch, first, unknown = max(10 * n, 1000), 0, []
        for _ in range(12):  # each round draws four times as many as the one before
            kept, unknown = where_filters(rows(first, batch), filters)
            kept = kept.limit(n)
            if kept.count() >= n:
                return kept, unknown
            batch *= 4
            if batch > 200_000_000:
                break
        raise RuntimeError(f"filters let too few rows pass: {filters}")


MARKS = [k / 200 for k in range(201)]


class EmpiricalCopula(GaussianCopula):
    """Marginals by 201 exact quantiles of the data, joined by the Gaussian copula of the ranks that these give."""

    def _fit(self, df: DataFrame) -> None:
        numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        self.quantiles = quantiles(df, numbers, MARKS)
        super()._fit(df)

    def _ranks(self, column: str, x: pd.Series) -> np.ndarray:
        return _place(x, self.quantiles[column])

    def _values(self, u: np.ndarray) -> dict[str, object]:
        out = super()._values(u)
        for k, c in enumerate(self.columns):
            if self.quantiles.get(c):
                out[c] = np.interp(u[:, k], MARKS, self.quantiles[c])
        return out


def _place(x: pd.Series, quantiles_: list[float] | None) -> np.ndarray:
    """Shares of the rows below each value, the middle of the range for tied quantiles; 0.5 for unknown ones."""
    if not quantiles_:
        return np.full(len(x), 0.5)
    q, known = np.array(quantiles_), x.notna().to_numpy()
    x = x.fillna(q[0]).to_numpy(dtype=float)
    low, high = np.searchsorted(q, x, side="left") / (len(q) - 1), (np.searchsorted(q, x, side="right") - 1) / (len(q) - 1)
    _, first = np.unique(q, return_index=True)
    inside = np.interp(x, q[first], np.array(MARKS)[first])
    return np.where(known, np.where(high > low, (low + high) / 2, inside), 0.5)


class VineCopula(EmpiricalCopula):
    """A C-vine over the numbers: each pair's family is the likeliest of the family set, its parameter by Kendall's tau.

    Taus and likelihoods come from counts of ranks on a grid, over all rows.  family_set is 'all', 'archimedean' or one
    family; trees limits the number of trees (all by default).  Categories are drawn independently by their shares.
    """

    def __init__(self, family_set: str = "all", trees: int | None = None, **kw):
        super().__init__(**kw)
        self.families, self.trees = vine.FAMILIES.get(family_set, (family_set,)), trees
        if not set(self.families) <= set(vine.FAMILIES["all"]):
            raise ValueError(f"family set {family_set!r} is not fitted; use one of {sorted({*vine.FAMILIES, *vine.FAMILIES['all']})}")

    def _fit(self, df: DataFrame) -> None:
        super()._fit(df)
        held, numbers = self.quantiles, self.numbers

        def ranks(batches):
            for b in batches:
                yield pd.DataFrame({c: _place(b[c], held[c]) for c in numbers})

        u = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numbers])
        self.vine = vine.CVine(u.mapInPandas(ranks, ", ".join(f"`{c}` double" for c in numbers)), numbers, self.families, self.trees) if numbers else None

    def _draw(self, rng, n: int) -> np.ndarray:
        u = rng.uniform(1e-9, 1 - 1e-9, size=(n, len(self.columns)))
        if self.vine:
            u[:, : len(self.numbers)] = self.vine.draw(rng, n)
        return u

    def tail_dependence_report(self) -> list[dict]:
        """Family, tau, lower and upper tail dependence of every pair of the vine."""
        return self.vine.report() if self.vine else []


class NeuralGenerator(BaseGenerator):
    """Placeholder for the GAN and VAE generators, which need a deep-learning package."""

    def __init__(self, kind: str = "ctgan", **kw):
        super().__init__(**kw)
        raise ImportError(f"{kind} needs the optional package 'sdv', which is not installed")


def make_generator(kind: str, **kw) -> BaseGenerator:
    kinds = {"auto": GaussianCopula, "copula": GaussianCopula, "empirical": EmpiricalCopula, "vine": VineCopula}
    if kind in ("ctgan", "tvae"):
        return NeuralGenerator(kind, **kw)
    if kind not in kinds:
        raise ValueError(f"unknown generator {kind!r}; use one of {sorted([*kinds, 'ctgan', 'tvae'])}")
    return kinds[kind](**kw)
