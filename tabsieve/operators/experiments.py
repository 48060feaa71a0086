"""Corruptions, detectors and their measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import hash_order, quantile, quantiles, running


def chance(key: Column, seed: int, label: str = "") -> Column:
    """A number in [0, 1) that a row's key decides: the first 32 bits of md5(label + seed~key)."""
    h = F.md5(F.concat(F.lit(f"{label}{seed}~"), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _places(df: DataFrame, key: str, seed: int, parts: int = 64) -> DataFrame:
    """df with place_, 1 to n in hash order: places within 4,096 hash ranges plus the counts of the ranges before."""
    h = df.withColumn("h_", hash_order(F.col(key), seed)).withColumn("r_", F.substring("h_", 1, 3))
    counts = h.groupBy("r_").agg(F.count("*").alias("n_"))
    before = counts.select("r_", F.coalesce(F.sum("n_").over(Window.partitionBy(F.lit(0)).orderBy("r_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b_"))
    own = F.row_number().over(Window.partitionBy("r_").orderBy("h_", key))
    return h.withColumn("own_", own).join(F.broadcast(before), "r_").withColumn("place_", F.col("own_") + F.col("b_")).drop("h_", "r_", "own_", "b_")  # 4,096 rows at most


def permute(df: DataFrame, key: str, columns: list[str], level: float, seed: int = 42) -> DataFrame:
    """Each column's values permuted among the rows that a hash picks with probability level."""
    out = df
    for k, c in enumerate(columns):
        some = df.where(chance(F.col(key), seed + k, "p") < level).select(key, c)
        a = _places(some.select(key), key, seed + 1000 + k)
        b = _places(some, key, seed + 2000 + k).select(F.col(c).alias("new_"), "place_")
        moved = a.join(b, "place_").select(key, F.struct("new_").alias("s_"))
        out = out.join(moved, key, "left").withColumn(c, F.when(F.col("s_").isNotNull(), F.col("s_.new_")).otherwise(F.col(c))).drop("s_")
    return out


def inject_cells(df: DataFrame, key: str, columns: list[str], level: float, seed: int = 42) -> DataFrame:
    """Cells replaced, with probability level, by the value of another row that a hash picks."""
    n = df.count()
    out = df
    for k, c in enumerate(columns):
        pool = _places(df.select(key, c), key, seed + 3000 + k).select(F.col("place_").alias("want_"), F.struct(F.col(c).alias("new_")).alias("s_"))
        pick = F.when(chance(F.col(key), seed + k, "i") < level, (F.floor(chance(F.col(key), seed + k, "j") * n) + 1).cast("long"))
        out = out.withColumn("want_", pick).join(pool, "want_", "left").withColumn(c, F.when(F.col("s_").isNotNull(), F.col("s_.new_")).otherwise(F.col(c))).drop("s_", "want_")
    return out


def drop_features(df: DataFrame, key: str, numeric: list[str], categorical: list[str], level: float, seed: int = 42) -> DataFrame:
    """In rows picked with probability level, half of the columns set to the median or most frequent value."""
    cols = [*numeric, *categorical]
    fill = {c: q[0] if q else None for c, q in quantiles(df, numeric, [0.5]).items()}
    if categorical:
        fill |= df.agg(*[F.mode(F.col(c), True).alias(c) for c in categorical]).first().asDict()
    hit = chance(F.col(key), seed, "d") < level
    order = F.sort_array(F.array(*[F.struct(F.md5(F.concat(F.lit(f"{c}{seed}~"), F.col(key).cast("string"))), F.lit(c).alias("c")) for c in cols]))
    gone = F.transform(F.slice(order, 1, len(cols) // 2), lambda x: x["c"])
    return df.withColumns({c: F.when(hit & F.array_contains(gone, c), F.lit(fill[c])).otherwise(F.col(c)) for c in cols})


def covariate_shift(df: DataFrame, key: str, column: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, by hash order, of those at or above the upper quartile of a column."""
    edge = quantile(df, column, 0.75)
    return df.where(F.col(column) >= F.lit(edge)).orderBy(hash_order(F.col(key), seed), key).limit(n)


def duplicate_rows(df: DataFrame, key: str, numeric: list[str], level: float, seed: int = 42) -> DataFrame:
    """df and copies of a share of its rows, numbers moved by 1 % of their deviation."""
    sd = df.agg(*[F.stddev_pop(c).alias(c) for c in numeric]).first()
    copies = df.where(chance(F.col(key), seed, "c") < level)
    noise = {c: F.col(c) + 0.01 * (sd[c] or 0.0) * (2 * chance(F.col(key), seed, c) - 1) for c in numeric}
    return df.unionByName(copies.withColumns(noise))


def hallucinate(df: DataFrame, key: str, column: str, level: float = 0.05, seed: int = 42) -> DataFrame:
    """A category replaced, with probability level, by another of its values that a hash picks."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]  # a row a category
    pick = F.get(F.array(*map(F.lit, values)), (chance(F.col(key), seed, "w") * len(values)).cast("int"))
    return df.withColumn(column, F.when(chance(F.col(key), seed, "h") < level, pick).otherwise(F.col(column)))


def strongest_pair(df: DataFrame, columns: list[str]) -> tuple[str, str]:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.abs(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))) for a, b in pairs]).first()
    return pairs[max(range(len(pairs)), key=lambda i: row[i] or 0.0)]


def conditional_swap(df: DataFrame, key: str, columns: list[str], level: float, seed: int = 42) -> DataFrame:
    """In picked rows the second column of the most correlated pair takes a value from the other half of the first."""
    a, b = strongest_pair(df, columns)
    med = quantile(df, a, 0.5)
    half = (F.col(a) > F.lit(med)).cast("int")
    counts = dict(df.where(F.col(a).isNotNull()).groupBy(half.alias("h")).count().collect())
    pools = [_places(df.where(half == h).select(key, b), key, seed + 7 + h).select((F.lit(1 - h)).alias("half_"), F.col("place_").alias("want_"), F.struct(F.col(b).alias("new_")).alias("s_")) for h in (0, 1)]
    size = F.when(half == 1, F.lit(counts.get(0, 0))).otherwise(F.lit(counts.get(1, 0)))
    pick = F.when(chance(F.col(key), seed, "x") < level, (F.floor(chance(F.col(key), seed, "y") * size) + 1).cast("long"))
    out = df.withColumn("half_", half).withColumn("want_", pick).join(pools[0].unionByName(pools[1]), ["half_", "want_"], "left")
    return out.withColumn(b, F.when(F.col("s_").isNotNull(), F.col("s_.new_")).otherwise(F.col(b))).select(*df.columns)


def detection_metrics(df: DataFrame, flag: str, score: str, truth: str) -> DataFrame:
    """(precision, recall, f1, roc_auc, average_precision) of flags and scores against the truth (booleans)."""
    n = df.groupBy(F.col(score).alias("s_")).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("q"), F.count_if(F.col(flag) & F.col(truth)).alias("tp"), F.count_if(F.col(flag)).alias("f"))
    n = running(n.where("s_ is not null").withColumns({"one_": F.lit(0), "down_": -F.col("s_"), "n": F.col("p") + F.col("q")}), ["one_"], "s_", ["q"]).withColumn("below", F.col("run_q") - F.col("q"))
    n = running(n, ["one_"], "down_", ["p", "n"]).withColumns({"cp": F.col("run_p"), "cn": F.col("run_n")})
    tp, f, p, q = (F.sum(c) for c in ("tp", "f", "p", "q"))
    safe = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    return n.agg(safe(tp, f).alias("precision"), safe(tp, p).alias("recall"), safe(2 * tp, f + p).alias("f1"), F.coalesce(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / F.nullif(p.cast("double") * q, F.lit(0.0)), F.lit(0.5)).alias("roc_auc"), safe(F.sum(F.col("p") * F.col("cp") / F.col("cn")), p).alias("average_precision"))


def matched_f1(df: DataFrame, score: str, truth: str, key: str, level: float) -> DataFrame:
    """(f1) when exactly max(1, int(n * level)) rows are flagged, those of greatest score (ties: greatest key)."""
    n = df.count()
    k = max(1, int(n * level))
    top = df.orderBy(F.desc(score), F.desc(key)).limit(k).agg(F.count_if(F.col(truth)).alias("tp"))
    pos = df.agg(F.count_if(F.col(truth)).alias("p"))
    return top.crossJoin(pos).select(F.coalesce(2.0 * F.col("tp") / F.nullif(F.lit(k) + F.col("p"), F.lit(0)), F.lit(0.0)).alias("f1"))


def identity_error(a: Column, b: Column, total: Column) -> Column:
    """How far total is from a + b, relative to the total."""
    return F.abs(a + b - total) / (F.abs(total) + 1e-9)


def cell_bounds(df: DataFrame, hub: str, others: list[str]) -> DataFrame:
    """(hub, n, support, epsilon): rows and distinct contexts of each hub value, and (support / n^2)^(1/4)."""
    g = df.groupBy(F.col(hub).alias("hub")).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in others])).alias("support"))
    return g.select("hub", "n", "support", F.pow(F.col("support") / (F.col("n").cast("double") * F.col("n")), F.lit(0.25)).alias("epsilon"))


def representation_drift(df: DataFrame, group: str, flag: str) -> DataFrame:
    """(grp, n, flag_rate, share_before, share_after, shift_pp) when flagged rows are removed."""
    g = df.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("f"))
    all_ = Window.partitionBy(F.lit(0))
    before, after = F.col("n") / F.sum("n").over(all_), (F.col("n") - F.col("f")) / F.nullif(F.sum(F.col("n") - F.col("f")).over(all_), F.lit(0))
    return g.select("grp", "n", (F.col("f") / F.col("n")).alias("flag_rate"), before.alias("share_before"), after.alias("share_after"), (100 * (after - before)).alias("shift_pp"))


def threshold_sweep(df: DataFrame, penalty: str, thresholds: list[float]) -> DataFrame:
    """(threshold, kept, rate): rows at or under each threshold."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(penalty) <= t).cast("int").alias("k")) for t in thresholds]))
    return df.select(each.alias("e")).groupBy(F.col("e.threshold").alias("threshold")).agg(F.sum("e.k").alias("kept"), F.avg("e.k").alias("rate"))


def group_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation and standard error by group."""
    n = F.count(value)
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), (F.stddev_samp(value) / F.sqrt(n)).alias("sem"))


def isolation_scores(df: DataFrame, trees: int = 100, rows: int = 256, seed: int = 42) -> DataFrame:
    """(id, score) of vectors (id, x) by an isolation forest grown on a hash-ordered sample of trees * rows rows at most."""
    pool = np.array(df.orderBy(F.xxhash64("id"), "id").limit(trees * rows).select("x").toPandas()["x"].tolist(), dtype=float)
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(max(2, min(rows, len(pool))))))

    def grow(x, level):
        wide = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
        if level >= depth or not len(wide):
            return (len(x),)
        f = int(rng.choice(wide))
        cut = rng.uniform(x[:, f].min(), x[:, f].max())
        return (f, cut, grow(x[x[:, f] < cut], level + 1), grow(x[x[:, f] >= cut], level + 1))

    forest = [grow(pool[rng.choice(len(pool), min(rows, len(pool)), replace=False)], 0) for _ in range(trees)]
    c = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    norm = c(min(rows, len(pool))) or 1.0

    def walk(node, x, at, level, out):
        if len(node) == 1:
            out[at] += level + c(node[0])
        else:
            low = x[at, node[0]] < node[1]
            for side, kid in ((at[low], node[2]), (at[~low], node[3])):
                if len(side):
                    walk(kid, x, side, level + 1, out)

    def score(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), dtype=float)
            total = np.zeros(len(x))
            for t in forest:
                walk(t, x, np.arange(len(x)), 0, total)
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "score": 2 ** (-total / trees / norm)})

    return df.select("id", "x").mapInArrow(score, "id long, score double")


def mixture_density(df: DataFrame, most: int = 6, seed: int = 42) -> tuple[int, DataFrame]:
    """Number of components (least BIC over 1 to `most`) and (id, log_density) of vectors (id, x)."""
    rows = df.select("id", "x", array_to_vector("x").alias("features")).cache()
    n, d = rows.count(), len(rows.first()["x"])
    mean = np.array(rows.agg(*[F.avg(F.col("x")[i]) for i in range(d)]).first(), dtype=float)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    flat = rows.agg(*[F.covar_pop(F.col("x")[i], F.col("x")[j]) for i, j in pairs]).first()
    cov = np.zeros((d, d))
    for (i, j), c in zip(pairs, flat, strict=True):
        cov[i, j] = cov[j, i] = c
    one = cov + 1e-9 * np.eye(d)
    likelihood = -n / 2 * (d * np.log(2 * np.pi) + np.linalg.slogdet(one)[1] + d)
    fits = [(-2 * likelihood + (d + d * (d + 1) / 2) * np.log(n), 1, [(1.0, mean, one)])]
    for k in range(2, most + 1):
        m = GaussianMixture(k=k, seed=seed, maxIter=30).fit(rows)
        free = k * (d + d * (d + 1) / 2) + k - 1
        fits.append((-2 * m.summary.logLikelihood + free * np.log(n), k, [(w, np.array(g.mean.toArray()), np.array(g.cov.toArray()) + 1e-9 * np.eye(d)) for w, g in zip(m.weights, m.gaussians, strict=True)]))
    _, k, parts = min(fits, key=lambda f: f[0])

    def density(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), dtype=float)
            logs = []
            for w, mean, cov in parts:
                z = x - mean
                logs.append(np.log(w) - 0.5 * ((z @ np.linalg.inv(cov)) * z).sum(1) - 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1]))
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "log_density": np.logaddexp.reduce(logs, axis=0)})

    return k, df.select("id", "x").mapInArrow(density, "id long, log_density double")


def unfinished(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs that a results table does not hold yet."""
    return jobs.join(done.select(*keys), keys, "left_anti")
