"""Embedding near-dedup by product quantisation.

Vectors are scaled to length one.  A coarse quantiser deals them to inverted lists; what is left after the nearest
centroid is coded by subspace.  Each vector looks through the lists nearest to it: table-lookup distances to the
codes there rule pairs out (the distance to a decoded vector differs from the true one by the coding error at most,
which is stored, so none is ruled out wrongly), and the rest are compared by exact cosine in double precision.

The quantisers are fitted on a bounded sample; all vectors are indexed, in lists whose number grows with the square root
of the vectors'.  The number of lists probed is calibrated so
that a pair at the threshold meets with probability RECALL from one side alone; each pair is tried from both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, saved

SAMPLE = 8192  # vectors that the quantisers are fitted on
LISTS = 64  # lists at least; their number grows with the square root of the vectors'
FLAT = 1024  # lists that one level of centroids makes; beyond it, each is parted by a second level
PARTS, CODES = 8, 32  # subspaces, and code words in each
RECALL = 0.995
BLOCK, ASKS = 2048, 16384  # list members and queries that one task takes


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's algorithm from a fixed seed; fewer than k if there are fewer rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T * 2 - (c * c).sum(1)).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centroids on one level or two, and subspace code words.

    List a * len(fine) + b holds what is nearest to coarse[a] + fine[b]; only the two levels are kept, at most FLAT
    vectors and one for every FLAT lists, so what is broadcast hardly grows.
    """

    def __init__(self, sample: np.ndarray, lists: int, cosine: float, seed: int = 7):
        self.coarse, self.fine = _kmeans(sample, min(lists, FLAT), seed=seed), np.zeros((1, sample.shape[1]))
        if lists > FLAT:
            rest = sample - self.coarse[(sample @ self.coarse.T * 2 - (self.coarse**2).sum(1)).argmax(1)]
            self.fine = _kmeans(rest, -(-lists // FLAT), seed=seed)
        self.cross = 2 * self.coarse @ self.fine.T + (self.coarse**2).sum(1)[:, None] + (self.fine**2).sum(1)
        rest = sample - self.centroid(self.nearest(sample, 1)[:, 0])
        self.parts = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        self.words = [_kmeans(rest[:, p], CODES, seed=seed) for p in self.parts]
        self.probes = self._probes(sample, cosine, seed)

    @property
    def lists(self) -> int:
        return self.cross.size

    def centroid(self, which) -> np.ndarray:
        return self.coarse[which // len(self.fine)] + self.fine[which % len(self.fine)]

    def _far(self, x: np.ndarray) -> np.ndarray:
        """Squared distance to every list's centroid, less the vector's own square."""
        return (self.cross - 2 * (x @ self.coarse.T)[:, :, None] - 2 * (x @ self.fine.T)[:, None, :]).reshape(len(x), -1)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        step = max(1, (1 << 22) // self.lists)
        out = [np.empty((0, min(n, self.lists)), dtype=np.int64)]
        for a in range(0, len(x), step):
            far = self._far(x[a : a + step])
            if n < self.lists // 8:
                near = np.sort(np.argpartition(far, n - 1, axis=1)[:, :n], axis=1)
                out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1))
            else:
                out.append(np.argsort(far, axis=1, kind="stable")[:, :n])
        return np.concatenate(out)

    def _probes(self, sample: np.ndarray, cosine: float, seed: int) -> int:
        """How many lists a vector must look through to meet one at the threshold with probability RECALL."""
        rng = np.random.default_rng(seed)
        x = sample[:4096]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(away, axis=1, keepdims=True)
        y = cosine * x + np.sqrt(1 - cosine * cosine) * away / np.where(size > 0, size, 1)
        place, step = [], max(1, (1 << 22) // self.lists)
        for a in range(0, len(x), step):
            far = self._far(y[a : a + step])
            place.append((far < np.take_along_axis(far, self.nearest(x[a : a + step], 1), 1)).sum(1))
        return int(np.quantile(np.concatenate(place), RECALL, method="higher")) + 1

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of each vector's residual, and the length of what the code leaves out."""
        rest = x - self.centroid(home)
        codes = np.empty((len(x), len(self.parts)), dtype=np.uint8)
        left = np.zeros(len(x))
        for k, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
            codes[:, k] = (rest[:, p] @ w.T * 2 - (w * w).sum(1)).argmax(1)
            left += ((rest[:, p] - w[codes[:, k]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def distances(self, q: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from queries to the decoded members of a list, summed from one table a subspace."""
        rest = q - self.centroid(home)
        out = np.zeros((len(q), len(codes)), dtype=np.float32)
        for k, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
            table = ((rest[:, p] ** 2).sum(1)[:, None] - 2 * rest[:, p] @ w.T + (w * w).sum(1)).astype(np.float32)
            out += table[:, codes[:, k]]
        return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): vectors that have an id and finite, non-null components that are not all zero."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("x")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(arr):
        return np.empty((0, 0))
    return np.asarray(arr.flatten(), dtype=np.float64).reshape(len(arr), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable by links, itself included), kept.

    Vectors link if their cosine is at least `cosine`, whatever else the rows hold.  Null, zero and non-finite
    vectors and rows with a null id link with nothing (a null id gives a null component).  Vectors of different
    length are never compared.  Rows of one id count as one vector, the smallest of theirs.  Up to BLOCK vectors of one
    length are compared with one another in one task; quantisers are fitted for lengths that more vectors have.
    """
    good = usable(vectors, id_col, vec_col).groupBy("id").agg(F.min("x").alias("x")).withColumn("a", F.xxhash64("x")).withColumn("b", F.xxhash64(F.lit(1), "x"))
    # Equal vectors are compared once, by the smallest id, and count as many as they are.
    kinds = saved(good.groupBy("a", "b").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first("x").alias("x")).withColumn("d", F.size("x")))
    sizes = kinds.groupBy("d").agg(F.count("*").alias("n"))
    common = [(r[0], r[1]) for r in sizes.where(F.col("n") > BLOCK).orderBy("d").collect()]  # a row for each BLOCK vectors at most
    few = kinds.where(~F.col("d").isin([d for d, _ in common])) if common else kinds
    found = few.select("d", "id", "w", "x").groupBy("d").applyInArrow(lambda t: _compared(t, cosine), "id long, n long, root long")
    for d, n in common:
        found = found.unionByName(_links(kinds.where(F.col("d") == d).select("id", "w", "x"), n, cosine))
    found = saved(found)
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    group = components(found.where("root <> id").select(F.col("id").alias("u"), F.col("root").alias("v")))
    each = kinds.select("a", "b", "id", "w").join(links, "id", "left").join(group.withColumnRenamed("node", "id"), "id", "left")
    each = each.select("a", "b", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    each = good.select(F.col("id").alias("vec_id"), "a", "b").join(each, ["a", "b"]).drop("a", "b")
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(each, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _compared(table: pa.Table, cosine: float) -> pa.Table:
    """(id, n, root) of at most BLOCK vectors of one length, each compared with all others and weighed by w."""
    ids, x = np.asarray(table.column("id").combine_chunks()), _unit(_matrix(table.column("x")))
    hit = x @ x.T >= cosine
    np.fill_diagonal(hit, False)
    label = np.arange(len(ids))
    for r in np.flatnonzero(hit.any(1)):
        labels = np.unique(np.append(label[hit[r]], label[r]))
        if len(labels) > 1:
            label[np.isin(label, labels)] = labels[0]
    n, some = hit @ np.asarray(table.column("w").combine_chunks()), np.flatnonzero(hit.any(1))
    return pa.table({"id": pa.array(ids[some], pa.int64()), "n": pa.array(n[some], pa.int64()), "root": pa.array(ids[label[some]], pa.int64())})


def _links(good: DataFrame, n: int, cosine: float) -> DataFrame:
    """(id, n, root): partial numbers of links, weighed by w, and edges that span the links, of vectors of one length."""
    spark = good.sparkSession
    sample = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["x"]  # SAMPLE vectors at most
    lists = int(max(LISTS, n**0.5 / 2))
    quantiser = spark.sparkContext.broadcast(Quantiser(_unit(np.array(sample.tolist(), dtype=float)), lists, cosine))

    def index(batches):
        q = quantiser.value
        for b in batches:
            x = _matrix(b.column(2))
            if not len(x):
                continue
            near = q.nearest(_unit(x), q.probes)
            small = x.astype(np.float32)
            blobs = [v.tobytes() for v in (small if (small == x).all() else x)]
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "w": b.column(1), "home": pa.array(near[:, 0], pa.int32()), "probes": pa.array(near.tolist(), pa.list_(pa.int32())), "x": pa.array(blobs, pa.binary())})

    rows = saved(good.mapInArrow(index, "id long, w long, home int, probes array<int>, x binary"))
    # A row a list: how many blocks of members and turns of queries its vectors make.
    held = rows.groupBy("home").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    asked = rows.select(F.explode("probes").alias("home")).groupBy("home").agg(F.ceil(F.count("*") / F.lit(ASKS)).alias("turns"))
    sizes = saved(held.join(asked, "home"))
    spread = lambda name, of: F.explode(F.sequence(F.lit(0), F.col(of).cast("int") - 1)).alias(name)
    members = rows.join(sizes, "home").select("home", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), spread("turn", "turns"), "id", "w", "probes", "x")
    asks = rows.select(F.explode("probes").alias("home"), "id", "w", F.col("home").alias("own"), "x").join(sizes, "home")
    asks = asks.select("home", spread("block", "blocks"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("turns")).cast("int").alias("turn"), "id", "w", "own", "x")

    # New names for columns of one origin, so that the two sides can meet.
    members, asks = (d.toDF(*d.columns) for d in (members, asks))

    def search(key, members, asks):
        q, home = quantiser.value, key[0].as_py()
        none = pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not len(members) or not len(asks):
            return none
        dims = q.coarse.shape[1]

        def matrix(blobs):
            wide = [np.frombuffer(v, dtype=np.float32 if len(v) == 4 * dims else np.float64).astype(float) for v in blobs]
            return _unit(np.stack(wide))

        mid, aid = np.asarray(members.column("id").combine_chunks()), np.asarray(asks.column("id").combine_chunks())
        mw, aw = np.asarray(members.column("w").combine_chunks()), np.asarray(asks.column("w").combine_chunks())
        mx = matrix(members.column("x").to_pylist())
        codes, left = q.encode(mx, np.full(len(mid), home))
        homes, own = np.unique(np.asarray(asks.column("own").combine_chunks()), return_inverse=True)
        probed = np.zeros((len(mid), len(homes)), dtype=bool)  # does a member look through the list of a query?
        looks = members.column("probes").combine_chunks()
        who, at = np.repeat(np.arange(len(mid)), np.diff(np.asarray(looks.offsets))), np.asarray(looks.flatten())
        place = np.minimum(np.searchsorted(homes, at), len(homes) - 1)
        probed[who[homes[place] == at], place[homes[place] == at]] = True
        blobs = asks.column("x").to_pylist()
        ids = np.unique(np.concatenate([mid, aid]))
        mplace, aplace = np.searchsorted(ids, mid), np.searchsorted(ids, aid)
        label, total = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
        reach = np.float32(np.sqrt(2 - 2 * cosine) + 1e-3) + left.astype(np.float32)
        for a in range(0, len(aid), 256):
            x = matrix(blobs[a : a + 256])
            near = q.distances(x, home, codes) <= reach * reach
            some = np.flatnonzero(near.any(0))
            if not len(some):
                continue
            hit = near[:, some] & (x @ mx[some].T >= cosine)
            # A pair that both sides look for is counted where the larger id asks.
            late = aid[a : a + 256, None] > mid[None, some]
            hit &= (late | ~probed[some][:, own[a : a + 256]].T) & (aid[a : a + 256, None] != mid[None, some])
            np.add.at(total, aplace[a : a + 256], hit @ mw[some])
            np.add.at(total, mplace[some], aw[a : a + 256] @ hit)
            for r in np.flatnonzero(hit.any(1)):
                own_label = label[aplace[a + r]]
                labels = np.unique(np.append(label[mplace[some[hit[r]]]], own_label))
                if len(labels) > 1:
                    label[np.isin(label, labels)] = labels[0]
        some = np.flatnonzero(total)
        return pa.table({"id": ids[some], "n": total[some], "root": ids[label[some]]})

    return members.groupBy("home", "block", "turn").cogroup(asks.groupBy("home", "block", "turn")).applyInArrow(search, "id long, n long, root long")


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """linked_vectors() over all embeddings at a cosine of 0.9."""
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
