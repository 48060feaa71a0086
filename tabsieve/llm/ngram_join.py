"""N-gram Jaccard join by prefix trees: documents whose sets of word shingles overlap are put in one class.

1. Equal sets are reduced to the document with the smallest id.
2. Shingles are counted over those; their global order is by frequency, then by hash.  A set of n shingles can reach
   the threshold t only with a set that shares one of its n - ceil(t*n) + 1 rarest, so a document whose rarest ones
   occur nowhere else links with nothing and is done.
3. The others are grouped by shared rare shingles, and every group is joined by a walk over a prefix tree of its sets
   (see prefix_tree.py).  A group may chain unrelated sets by boilerplate: one larger than a block is joined either as a
   whole, by pairs of blocks, or for each of its rare shingles apart, whichever ships fewer sets (see cells()).

Shingles are 64-bit hashes of words hashed to 64 bits; sets are compared by two sums of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .components import components, saved
from .hashing import LOWER, NOT_SPACE, Rolling, byte_values, mix, words_of
from .prefix_tree import link

_LAST = np.iinfo(np.int64).max
_SET = np.dtype([("lo", "<u8"), ("hi", "<u8"), ("doc", "<i8")])
#: Sets that one task joins with one another or with as many others.
BLOCK = 2048
#: What a cell costs besides its sets, as a number of sets.
CELL = 16


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


class _Chunk:
    """Distinct shingles of each document of a chunk, end to end, and the hash of each set."""

    def __init__(self, table: pa.Table, size: int):
        data, offsets = X.texts_of(table)
        data = LOWER[data]
        start, end, doc = words_of(data, offsets, NOT_SPACE)
        words = Rolling(Rolling(byte_values(data)).spans(start, end))
        grams = words.grams(size)
        at = np.searchsorted(doc, np.arange(len(table) + 1))
        sets = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= size:
                sets.append(np.unique(grams[a : b - size + 1]))
            else:
                sets.append(words.spans(np.array([a]), np.array([b])) if b > a else np.empty(0, np.uint64))
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        self.grams = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        ids = np.asarray(pc.fill_null(table.column("id_").combine_chunks(), _LAST))
        self.ids = ids
        total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.grams ^ np.uint64(k)), dtype=np.uint64)]) for k in (0x51, 0xA7)]
        self.sets = np.empty(len(sets), dtype=_SET)
        for name, t in zip(("lo", "hi"), total, strict=True):
            self.sets[name] = mix((t[self.at[1:]] - t[self.at[:-1]]) + self.n.astype(np.uint64))
        self.sets["doc"] = ids
        self.used = np.flatnonzero((self.n > 0) & (ids != _LAST))

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """First document of each distinct set, by hash; and each used document's place among them."""
        s = self.sets[self.used]
        order = np.lexsort((s["doc"], s["hi"], s["lo"]))
        t = s[order]
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t["lo"][1:] != t["lo"][:-1]) | (t["hi"][1:] != t["hi"][:-1])
        place = np.empty(len(t), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        return self.used[order[new]], place

    def kept(self, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Documents that stand for their set."""
        return np.sort(first[owner == self.ids[first]])

    def counted(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shortened shingle hashes of some documents, how many of them have each, and each shingle's place."""
        parts = [self.grams[self.at[d] : self.at[d + 1]] for d in docs]
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        keys, place, count = np.unique(flat >> np.uint64(24), return_inverse=True, return_counts=True)
        return keys, place, count


def _smallest_ids(table: pa.Table) -> pa.Table:
    """For each set the smallest id of a document that has it, over all chunks."""
    rows = X.received(table)
    parts = [np.frombuffer(r[2], dtype=_SET) for r in rows]
    e = np.concatenate(parts)
    order = np.lexsort((e["doc"], e["hi"], e["lo"]))
    s = e[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s["lo"][1:] != s["lo"][:-1]) | (s["hi"][1:] != s["hi"][:-1])
    least = np.empty(len(s), dtype=np.int64)
    least[order] = s["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
    cuts = np.cumsum([0, *map(len, parts)])
    return X.messages([(r[0], r[1], b"I" + least[a:b].tobytes()) for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)])


def _pack(keys: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted 40-bit numbers as differences, byte plane by byte plane."""
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = step.view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()
    return _squeeze(len(keys).to_bytes(4, "little") + planes + np.minimum(count, 255).astype(np.uint8).tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _expand(blob)
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(raw, np.uint8, 5 * n, 4).reshape(5, n).T
    step = np.zeros((n, 8), dtype=np.uint8)
    step[:, :5] = planes
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64), np.frombuffer(raw, np.uint8, n, 4 + 5 * n)


def _frequencies(table: pa.Table) -> pa.Table:
    """Per shingle: 0 if one document has it, else 1 + the logarithm of the number that have it."""
    rows = X.received(table)
    got = [_unpack(r[2]) for r in rows]
    keys = np.concatenate([k for k, _ in got])
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=np.concatenate([c for _, c in got])[order])
    code = np.empty(len(keys), dtype=np.uint8)
    code[order] = np.where(total < 2, 0, 1 + np.floor(np.log2(np.maximum(total, 1)))).astype(np.uint8)[group]
    cuts = np.cumsum([0, *(len(k) for k, _ in got)])
    return X.messages([(r[0], r[1], b"F" + _squeeze(code[a:b].tobytes())) for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)])


def cells(tokens: DataFrame, group: DataFrame) -> DataFrame:
    """(id, component, cell): which sets (id) of a group (component) are joined with one another.

    tokens are (id, t), the rare shingles of each set; every pair that can link shares one.  A group of up to BLOCK sets
    is one cell.  For a larger one, the sets shipped are counted both ways: as one cell of b blocks, each set goes to b
    tasks; with a cell for each distinct list of sets that share a shingle, it goes to as many as it is listed in, and
    each list counts as CELL sets more.
    Chains of boilerplate take the second way, whose work grows with the group and not its square.
    """
    sizes = group.groupBy("component").agg(F.count("*").alias("m"))
    large = sizes.where(F.col("m") > BLOCK)
    whole = group.select("id", "component", F.lit(0).cast("long").alias("cell"))
    if large.isEmpty():
        return whole
    held = saved(tokens.join(group.join(large, "component"), "id").select("id", "component", "m", "t"))
    lists = held.groupBy("component", "m", "t").agg(F.count("*").alias("f"), F.min("id").alias("a"), F.max("id").alias("b"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h")).where("f > 1")
    lists = lists.groupBy("component", "m", "f", "a", "b", "h").agg(F.min("t").alias("t"))  # equal lists once
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK))
    cost = lists.groupBy("component", "m").agg(F.sum(F.col("f") * blocks("f") + CELL).alias("apart")).where(F.col("apart") < F.col("m") * blocks("m"))
    parted = saved(lists.join(cost.select("component"), "component").select("component", "t"))
    own = held.join(parted, ["component", "t"]).select("id", "component", F.col("t").alias("cell"))
    return whole.join(parted.select("component").distinct(), "component", "left_anti").select("id", "component", "cell").unionByName(own)


def shingle_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    A-Z are lower-cased; words are maximal runs of bytes other than ASCII white space; a document's set holds its
    distinct shingles of `size` words, or its whole sequence if it has fewer.  Two documents link when
    100 * intersection >= percent * union.  Null and empty texts have empty sets and link with nothing; rows with a
    null id link with nothing and have a null component; rows that share an id share its component.
    """
    n = X.chunk_count(docs, text_col)
    texts = X.dealt(docs, id_col, text_col, n)
    buckets = max(12, n // 4)

    def forward(got):
        return [(r[0], -1 - r[1], r[2]) for r in X.received(got)] if got is not None else []

    def ask_sets(table, _):
        if not len(table):
            return X.messages([])
        c = _Chunk(table, size)
        e = c.sets[c.kinds()[0]]
        cuts, chunk = X.split_points(e["lo"], buckets), table.column("chunk_")[0].as_py()
        return X.messages([(chunk, b, e[cuts[b] : cuts[b + 1]].tobytes()) for b in range(buckets) if cuts[b + 1] > cuts[b]])

    owners = X.exchange(X.per_chunk(texts, ask_sets, X.MESSAGE), _smallest_ids)

    def settled(table, got):
        c = _Chunk(table, size)
        first, place = c.kinds()
        mine = [r for r in X.received(got) if r[2][:1] == b"I"]
        owner = np.frombuffer(b"".join(r[2][1:] for r in mine), dtype=np.int64)
        return c, first, place, owner, c.kept(first, owner)

    def ask_counts(table, got):
        if not len(table):
            return X.messages([])
        c, _, _, _, kept = settled(table, got)
        keys, _, count = c.counted(kept)
        cuts = X.split_points(keys << np.uint64(24), buckets)
        chunk = table.column("chunk_")[0].as_py()
        return X.messages([(chunk, buckets + b, _pack(keys[cuts[b] : cuts[b + 1]], count[cuts[b] : cuts[b + 1]])) for b in range(buckets) if cuts[b + 1] > cuts[b]] + forward(got))

    def count(table):
        if table.column("bucket_")[0].as_py() < 0:
            return X.messages([(r[0], -1 - r[1], r[2]) for r in X.received(table)])
        return _frequencies(table)

    counts = X.exchange(X.per_chunk(texts, ask_counts, X.MESSAGE, owners), count)

    shape = "doc_id long, n_shingles long, owner long, rare array<long>, grams binary, codes binary"

    def emit(table, got):
        c, _, place, owner, kept = settled(table, got)
        code = np.frombuffer(b"".join(_expand(r[2][1:]) for r in X.received(got) if r[2][:1] == b"F"), dtype=np.uint8)
        _, where, _ = c.counted(kept)
        code = code[where] if len(where) else code
        stands: list = [None] * len(table)
        for d, p in zip(c.used, place, strict=True):
            stands[d] = int(owner[p])
        rare: list = [None] * len(table)
        grams: list = [None] * len(table)
        codes: list = [None] * len(table)
        at = 0
        for d in kept:
            k = int(c.n[d])
            g, f = c.grams[c.at[d] : c.at[d + 1]], code[at : at + k]
            at += k
            front = k - -(-percent * k // 100) + 1
            order = np.lexsort((g, f))
            head = order[:front]
            head = head[f[head] > 0]
            if len(head):
                rare[d] = g[head].view(np.int64)
                back = order[::-1]
                grams[d], codes[d] = g[back].tobytes(), f[back].tobytes()
        return pa.table({"doc_id": table.column("id_"), "n_shingles": pa.array(c.n, pa.int64()), "owner": pa.array(stands, pa.int64()), "rare": pa.array(rare, pa.list_(pa.int64())), "grams": pa.array(grams, pa.binary()), "codes": pa.array(codes, pa.binary())})

    rows = saved(X.per_chunk(texts, emit, shape, counts))
    sets = rows.where("grams is not null").select(F.col("doc_id").alias("id"), "n_shingles", "rare", "grams", "codes")

    # Documents that share a rare shingle, as a star around the smallest of them.
    tokens = sets.select("id", F.explode("rare").alias("t"))
    centre = tokens.groupBy("t").agg(F.min("id").alias("v"), F.max("id").alias("w")).where("v < w").select("t", "v")
    stars = tokens.join(centre, "t").where("id <> v").select(F.col("id").alias("u"), "v").distinct()
    group = components(stars).withColumnRenamed("node", "id")

    # Blocks of a cell: as many as keep a task's sets to BLOCK.
    held = cells(tokens, group)
    sizes = held.groupBy("component", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = held.join(sizes, ["component", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A pair of blocks (i, j), i <= j, is a task; a set goes to every pair that has its block.
    pairs = dealt.select("id", "component", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    tasks = pairs.join(sets.select("id", "grams", "codes"), "id")

    def join(key, table):
        i, j = key[2].as_py(), key[3].as_py()
        ids = np.asarray(table.column("id").combine_chunks())
        own = np.asarray(table.column("block").combine_chunks())
        order = np.lexsort((ids, own != i))  # block i first
        ids, own = ids[order], own[order]
        gs = [np.frombuffer(table.column("grams")[int(k)].as_py(), np.uint64) for k in order]
        cs = [np.frombuffer(table.column("codes")[int(k)].as_py(), np.uint8) for k in order]
        flat, freq = np.concatenate(gs), np.concatenate(cs)
        # Numbers in the global order, most frequent first.
        keys, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
        rank = np.empty(len(keys), dtype=np.int64)
        rank[np.lexsort((keys, 255 - freq[first].astype(np.int64)))] = np.arange(len(keys))
        cuts = np.cumsum([0, *map(len, gs)])
        seqs = [np.sort(rank[inverse[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        m = int((own == i).sum())
        union = link(seqs, range(m), range(m) if i == j else range(m, len(seqs)), percent)
        root = [union.find(k) for k in range(len(seqs))]
        u = [k for k in range(len(seqs)) if root[k] != k]
        return pa.table({"u": pa.array(ids[u], pa.int64()), "v": pa.array(ids[[root[k] for k in u]] if u else [], pa.int64())})

    links = tasks.groupBy("component", "cell", "i", "j").applyInArrow(join, "u long, v long")
    found = components(links)
    out = rows.select("doc_id", "n_shingles", "owner").join(found.select(F.col("node").alias("owner"), "component"), "owner", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "owner", "doc_id").alias("component_id"))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """shingle_classes() over all documents."""
    return shingle_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
