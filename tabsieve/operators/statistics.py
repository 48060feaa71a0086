"""Fidelity statistics of a real and a synthetic table, as lazy long tables.

Inputs are stacked tables (see frames.stack); nulls are dropped by column, or by pair of columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import long_form, quantile_rows, running

MIN_ROWS = 10
MOMENT_WEIGHTS = (0.40, 0.35, 0.15, 0.10)


def _side(value: Column, src: str) -> Column:
    return F.max(F.when(F.col("src") == src, value))


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def moments(stacked: DataFrame, columns: list[str]) -> DataFrame:
    """(col, e_mean, e_std, e_skew, e_kurt, score): errors of four moments, scaled; score 0 to 100.

    Columns with fewer than ten values on a side are left out.  A constant column has skewness 0 and kurtosis 3... of
    which only the differences count; both are taken as 0 there.
    """
    by = long_form(stacked, columns).groupBy("col", "src").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.coalesce(F.skewness("v"), F.lit(0.0)).alias("sk"), F.coalesce(F.kurtosis("v") + 3, F.lit(0.0)).alias("ku"))
    wide = by.groupBy("col").agg(*[_side(F.col(c), s).alias(f"{c}_{s}") for c in ("n", "m", "sd", "sk", "ku") for s in "rs"]).where(f"n_r >= {MIN_ROWS} and n_s >= {MIN_ROWS}")
    diff = lambda c: F.abs(F.col(f"{c}_r") - F.col(f"{c}_s"))
    scale = F.greatest("sd_r", F.lit(1e-8))
    errors = {"e_mean": diff("m") / scale, "e_std": diff("sd") / scale, "e_skew": diff("sk") / (F.abs("sk_r") + 0.5), "e_kurt": diff("ku") / (F.abs("ku_r") + 1)}
    wide = wide.withColumns({k: F.least(v, F.lit(1.0)) for k, v in errors.items()})
    loss = reduce(Column.__add__, [F.col(k) * w for k, w in zip(errors, MOMENT_WEIGHTS, strict=True)])
    return wide.select("col", *errors, F.round(_clip(100 * (1 - loss), 0, 100), 2).alias("score"))


def kolmogorov(stacked: DataFrame, columns: list[str]) -> DataFrame:
    """(col, score): 1 minus the greatest distance between the two distribution functions."""
    n = long_form(stacked, columns).groupBy("col", "v").agg(F.count_if(F.col("src") == "r").alias("r"), F.count_if(F.col("src") == "s").alias("s"))
    total = n.groupBy("col").agg(F.sum("r").alias("nr"), F.sum("s").alias("ns")).where(f"nr >= {MIN_ROWS} and ns >= {MIN_ROWS}")
    cdf = running(n, ["col"], "v", ["r", "s"]).join(F.broadcast(total), "col")  # a row a column
    return cdf.groupBy("col").agg((1 - F.max(F.abs(F.col("run_r") / F.col("nr") - F.col("run_s") / F.col("ns")))).alias("score"))


def total_variation(stacked: DataFrame, columns: list[str]) -> DataFrame:
    """(col, score): 100 times 1 minus half the summed differences of category shares."""
    n = long_form(stacked, columns).groupBy("col", "v").agg(F.count_if(F.col("src") == "r").alias("r"), F.count_if(F.col("src") == "s").alias("s"))
    total = n.groupBy("col").agg(F.sum("r").alias("nr"), F.sum("s").alias("ns")).where("nr > 0 and ns > 0")
    share = n.join(F.broadcast(total), "col").groupBy("col").agg(F.sum(F.abs(F.col("r") / F.col("nr") - F.col("s") / F.col("ns"))).alias("d"))
    return share.select("col", F.round(_clip(100 * (1 - F.col("d") / 2), 0, 100), 2).alias("score"))


def cramers_v(stacked: DataFrame, a: str, b: str) -> DataFrame:
    """(src, v): bias-corrected association of two categorical columns."""
    x = stacked.select("src", F.col(a).alias("a_"), F.col(b).alias("b_")).where("a_ is not null and b_ is not null")
    o = x.groupBy("src", "a_", "b_").agg(F.count("*").alias("o"))
    o = o.withColumn("ra", F.sum("o").over(Window.partitionBy("src", "a_"))).withColumn("cb", F.sum("o").over(Window.partitionBy("src", "b_")))
    g = o.groupBy("src").agg(F.sum("o").cast("double").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("q"), F.count_distinct("a_").alias("r"), F.count_distinct("b_").alias("k"))
    n1 = F.nullif(F.col("n") - 1, F.lit(0.0))
    phi = F.greatest(F.lit(0.0), F.col("q") - 1 - (F.col("k") - 1) * (F.col("r") - 1) / n1)
    rt, kt = (F.col(c) - (F.col(c) - 1) * (F.col(c) - 1) / n1 for c in "rk")
    room = F.least(rt, kt) - 1
    return g.select("src", F.when(room > 0, F.sqrt(phi / F.when(room > 0, room))).otherwise(0.0).alias("v"))


def correlation_ratio(stacked: DataFrame, category: str, number: str) -> DataFrame:
    """(src, v): the square root of the share of variance between categories."""
    x = stacked.select("src", F.col(category).alias("a_"), F.col(number).alias("y_")).where("a_ is not null and y_ is not null")
    by = x.groupBy("src", "a_").agg(F.count("*").alias("n"), F.avg("y_").alias("m"), F.var_pop("y_").alias("w"))
    mean = by.groupBy("src").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"))
    g = by.join(F.broadcast(mean), "src").groupBy("src").agg(F.sum(F.col("n") * (F.col("m") - F.col("mm")) * (F.col("m") - F.col("mm"))).alias("b"), F.sum(F.col("n") * F.col("w")).alias("w"))
    total = F.col("b") + F.col("w")
    return g.select("src", F.when(total > 0, F.sqrt(_clip(F.col("b") / F.nullif(total, F.lit(0.0)), 0, 1))).otherwise(0.0).alias("v"))


def _ranks(x: DataFrame, column: str) -> DataFrame:
    """(src, column, rank): average ranks of the distinct values, so that only counts are ordered."""
    n = running(x.groupBy("src", column).agg(F.count("*").alias("k")), ["src"], column, ["k"])
    return n.select("src", column, (F.col("run_k") - (F.col("k") - 1) / 2).alias(f"rank_{column}"))


def _pearson(g: DataFrame, x: str, y: str) -> DataFrame:
    cov, sx, sy = F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)
    return g.groupBy("src").agg(F.coalesce(cov / F.nullif(sx * sy, F.lit(0.0)), F.lit(0.0)).alias("v"))


def spearman(stacked: DataFrame, a: str, b: str) -> DataFrame:
    """(src, v): rank correlation with average ranks over rows where both are known; 0 for a constant."""
    x = stacked.select("src", F.col(a).alias("a_"), F.col(b).alias("b_")).where("a_ is not null and b_ is not null")
    return _pearson(x.join(_ranks(x, "a_"), ["src", "a_"]).join(_ranks(x, "b_"), ["src", "b_"]), "rank_a_", "rank_b_")


def associations(stacked: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(i, j, src, v) over the upper triangle: rank correlation, correlation ratio or Cramer's V by the columns' kinds."""
    cols = [*numeric, *categorical]
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            if a in numeric and b in numeric:
                d = spearman(stacked, a, b)
            elif a in numeric:
                d = correlation_ratio(stacked, b, a)
            else:
                d = cramers_v(stacked, a, b)
            parts.append(d.select(F.lit(a).alias("i"), F.lit(b).alias("j"), "src", F.col("v").alias("v")))
    return reduce(DataFrame.unionByName, parts)


def correlation_distance(stacked: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(score): 100 times 1 minus the scaled Frobenius distance of the two association matrices (100 for < 2 columns)."""
    n = len(numeric) + len(categorical)
    if n < 2:
        return stacked.sparkSession.createDataFrame([(100.0,)], "score double")
    pair = associations(stacked, numeric, categorical).groupBy("i", "j").agg(*[F.coalesce(_side(F.col("v"), s), F.lit(0.0)).alias(s) for s in "rs"])
    d = F.sqrt(2 * F.sum((F.col("r") - F.col("s")) * (F.col("r") - F.col("s"))))
    return pair.agg(F.round(F.greatest(F.lit(0.0), 1 - d / (2 * (n * (n - 1)) ** 0.5)) * 100, 2).alias("score"))


def tails(stacked: DataFrame, columns: list[str]) -> DataFrame:
    """(col, score): how alike the tails are, by (p99 - median) over the interquartile range."""
    n = long_form(stacked, columns).groupBy("col", "src", "v").agg(F.count("*").alias("k"))
    q = quantile_rows(n, ["col", "src"], "v", "k", [0.25, 0.5, 0.75, 0.99])
    q = q.withColumn("t", (F.col("q")[3] - F.col("q")[1]) / F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1e-9)))
    w = q.groupBy("col").agg(_side(F.col("t"), "r").alias("r"), _side(F.col("t"), "s").alias("s"))
    return w.select("col", F.greatest(F.lit(0.0), 100 - F.abs(F.col("r") - F.col("s")) / F.greatest(F.abs("r"), F.lit(1e-9)) * 100).alias("score"))


def concentration(stacked: DataFrame, columns: list[str], share: float = 0.05) -> DataFrame:
    """(col, r, s, score): share of the summed magnitudes that the largest 5 % hold, and how alike it is.

    Ties are taken by value, from counts: only distinct magnitudes are ordered.
    """
    n = long_form(stacked, columns).groupBy("col", "src", F.abs("v").alias("x")).agg(F.count("*").alias("k"))
    total = n.groupBy("col", "src").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("x")).alias("total"))
    n = running(n.withColumn("down", -F.col("x")), ["col", "src"], "down", ["k"]).withColumn("before", F.col("run_k") - F.col("k")).join(F.broadcast(total), ["col", "src"])  # a row a column and table
    top = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)))
    take = F.greatest(F.lit(0), F.least(F.col("k"), top - F.col("before")))
    by = n.groupBy("col", "src").agg((F.sum(take * F.col("x")) / F.nullif(F.max("total"), F.lit(0.0))).alias("c"))
    w = by.groupBy("col").agg(F.coalesce(_side(F.col("c"), "r"), F.lit(0.0)).alias("r"), F.coalesce(_side(F.col("c"), "s"), F.lit(0.0)).alias("s"))
    return w.select("col", "r", "s", F.greatest(F.lit(0.0), 100 - F.abs(F.col("r") - F.col("s")) / F.greatest(F.abs("r"), F.lit(1e-9)) * 100).alias("score"))


def predictive_parity(stacked: DataFrame, numeric: list[str]) -> DataFrame:
    """(parity): rank correlation of the two tables' rank correlations, times 100, at least 0; null for < 3 columns."""
    spark = stacked.sparkSession
    if len(numeric) < 3:
        return spark.createDataFrame([(None,)], "parity double")
    pair = associations(stacked, numeric, []).groupBy("i", "j").agg(_side(F.col("v"), "r").alias("r"), _side(F.col("v"), "s").alias("s"))
    # A row a pair of columns: brought over once, as ranking it needs it several times.
    one = spark.createDataFrame([("x", r["r"], r["s"]) for r in pair.collect()], "src string, r double, s double")
    return spearman(one, "r", "s").select(F.greatest(F.lit(0.0), F.col("v") * 100).alias("parity"))


def auc(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """(auc): the chance that a positive scores above a negative, ties half; 0.5 if a side is empty."""
    n = scored.groupBy(F.col(score).alias("s_")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    n = running(n.where("s_ is not null").withColumn("one_", F.lit(0)), ["one_"], "s_", ["q"]).withColumn("below", F.col("run_q") - F.col("q"))
    return n.agg(F.coalesce(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / F.nullif(F.sum("p").cast("double") * F.sum("q"), F.lit(0.0)), F.lit(0.5)).alias("auc"))
