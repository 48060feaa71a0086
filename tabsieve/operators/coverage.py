"""Nearest-neighbour coverage of a synthetic table, and local outlier factors."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .binning import encoder
from .frames import sample

STEPS = 30
#: Rows of each table that coverage() samples.
MAX_ROWS = 10_000
#: Numbers of base vectors that are broadcast at a time; a larger base is taken in blocks.
BLOCK_VALUES = 2_000_000


def _matrix(df: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block by id; of equal vectors only the k smallest ids, as no others can be among the nearest."""
    rows = df.select("id", "x").toPandas()  # BLOCK_VALUES numbers or so
    ids, m = rows["id"].to_numpy(), np.array(rows["x"].tolist(), dtype=float)
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    if not len(ids):
        return ids, m
    same = np.unique(m, axis=0, return_inverse=True)[1].ravel()
    by = np.argsort(same, kind="stable")
    first = np.searchsorted(same[by], same[by])
    keep = np.sort(by[np.arange(len(by)) - first < k])
    return ids[keep], m[keep]


def _block(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(id, base_id, d): the k nearest of a base that fits in a broadcast matrix, for every query; queries stream past it."""
    held = base.sparkSession.sparkContext.broadcast(_matrix(base, k))

    def search(batches):
        ids, m = held.value
        sq = (m * m).sum(1) if len(ids) else np.empty(0)
        least = min(k, len(ids))
        for b in batches if least else ():
            qid = np.asarray(b.column(0))
            x = np.array(b.column(1).to_pylist(), dtype=float)
            for a in range(0, len(x), 128):
                part = x[a : a + 128]
                own = (part * part).sum(1)
                rough = own[:, None] - 2 * part @ m.T + sq
                # Whatever may tie with the k-th after rounding, or pass it for the error of the rough distance, is measured.
                scale = own + sq.max()
                most = np.partition(rough, least - 1, axis=1)[:, least - 1] + 1e-11 * (scale + np.sqrt(scale)) + 1e-24
                i, j = np.nonzero(rough <= most[:, None])
                d = np.sqrt(((part[i] - m[j]) ** 2).sum(-1))
                order = np.lexsort((ids[j], np.round(d, 12), i))
                i, j, d = i[order], j[order], d[order]
                few = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pa.RecordBatch.from_pydict({"id": qid[a : a + 128][i[few]], "base_id": ids[j[few]], "d": d[few]})

    return queries.select("id", "x").mapInArrow(search, "id long, base_id long, d double")


def neighbours(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(id, base_id, d, rank): the k nearest of all base vectors (id, x) for every query (id, x).

    The base is taken in blocks by a hash of the id; each is broadcast, and the k nearest of the blocks are merged.
    Distances are equal if they agree to twelve places; ties go to the smaller id.
    """
    values = base.agg(F.sum(F.size("x"))).first()[0] or 0
    blocks = max(1, math.ceil(values / BLOCK_VALUES))
    found = reduce(DataFrame.unionByName, [_block(queries, base.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), k) for b in range(blocks)])
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("d", 12), "base_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def coverage(real: DataFrame, synthetic: DataFrame, numeric: list[str], categorical: list[str], key: str, max_rows: int = MAX_ROWS, seed: int = 42) -> DataFrame:
    """(alpha_precision, beta_recall, authenticity) over equally many hash-sampled rows of each table.

    alpha_precision compares, for 30 balls around the real centre, the shares of real and synthetic rows inside;
    beta_recall does so with the synthetic rows nearest to real ones; authenticity is the share of synthetic rows that
    are nearer to a real row than to another synthetic one.
    """
    n = min(real.count(), synthetic.count(), max_rows)
    if n < 10:
        raise ValueError("needs 10 rows in each table")
    a, b = sample(real, key, n, seed), sample(synthetic, key, n, seed)
    vec = encoder(a, numeric, categorical).alias("x")
    r, s = (d.select(F.col(key).cast("long").alias("id"), vec).cache() for d in (a, b))
    dims = len(r.first()["x"])
    centre = r.agg(*[F.avg(F.col("x")[i]).alias(f"c{i}") for i in range(dims)]).first()
    to = lambda c: F.sqrt(sum((c[i] - F.lit(centre[i])) * (c[i] - F.lit(centre[i])) for i in range(dims)))
    alphas = [i / (STEPS - 1) for i in range(STEPS)]
    radii = r.agg(F.percentile(to(F.col("x")), F.array(*map(F.lit, alphas)))).first()[0]

    def curve(d: DataFrame) -> list[float]:
        return list(d.agg(*[F.avg((F.col("d") <= F.lit(q)).cast("double")) for q in radii]).first())

    precision = curve(s.select(to(F.col("x")).alias("d")))
    near = neighbours(r, s, 1).select("base_id").join(s.select(F.col("id").alias("base_id"), to(F.col("x")).alias("d")), "base_id")
    recall = curve(near.select("d"))
    score = lambda c: max(0.0, 1 - sum(abs(x - y) for x, y in zip(alphas, c, strict=True)) / sum(alphas))
    ds = neighbours(s, r, 1).select("id", F.col("d").alias("dr"))
    dd = neighbours(s, s, 2).where("rank = 2").select("id", F.col("d").alias("ds"))
    auth = ds.join(dd, "id").agg(F.avg((F.col("dr") < F.col("ds")).cast("double"))).first()[0]
    return real.sparkSession.createDataFrame([(score(precision), score(recall), float(auth))], "alpha_precision double, beta_recall double, authenticity double")


def local_outlier_factor(df: DataFrame, k: int = 20) -> DataFrame:
    """(id, lof) of vectors (id, x): mean local density of the k neighbours over the own."""
    nn = neighbours(df, df, k + 1).where("id <> base_id")
    w = Window.partitionBy("id").orderBy("rank")
    nn = nn.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).cache()
    kd = nn.groupBy("id").agg(F.max("d").alias("kd"))
    reach = nn.join(kd.select(F.col("id").alias("base_id"), "kd"), "base_id").groupBy("id").agg((1 / F.greatest(F.avg(F.greatest("d", "kd")), F.lit(1e-10))).alias("lrd"))
    other = nn.join(reach.select(F.col("id").alias("base_id"), F.col("lrd").alias("o")), "base_id").groupBy("id").agg(F.avg("o").alias("o"))
    return other.join(reach, "id").select("id", (F.col("o") / F.col("lrd")).alias("lof"))
