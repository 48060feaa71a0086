"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import blocks, texts_of, tidy
from .hashing import ALNUM_OR_HIGH, LOWER, NOT_SPACE, Rolling, byte_values, mix, words_of

BITS = 18
#: Labelled rows that the classifier is fitted on at most, taken by the order of a hash of their ids.
MAX_TRAIN = 20_000
#: Times that the fit goes through the labelled rows.
EPOCHS = 3
#: Text whose features are held at once.
BLOCK_BYTES = 1_000_000
_MARK = np.uint64(0xA24BAED4963EE407)


def features(table: pa.Table, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each document of a table with text_: document of each, index, and each document's count.

    Words are runs of letters, digits and non-ASCII bytes, or runs of other visible bytes; features are words and
    pairs of neighbours.  A word counts by its letters and, apart, by its form (case and kind), so that unseen words
    still say something.
    """
    data, offsets = texts_of(table)
    a, b, da = words_of(data, offsets, ALNUM_OR_HIGH | _upper())
    mark = NOT_SPACE & ~(ALNUM_OR_HIGH | _upper())
    c, d, dc = words_of(data, offsets, mark)
    low = Rolling(byte_values(LOWER[data]))
    word = low.spans(a, b)
    upper = np.concatenate([[0], np.cumsum(_upper()[data])])
    caps = np.minimum(upper[b] - upper[a], 2) + 3 * np.minimum(b - a, 2)
    form = mix(caps.astype(np.uint64) ^ _MARK)
    sign = mix(low.spans(c, d) ^ _MARK)
    start = np.concatenate([a, c])
    order = np.argsort(start, kind="stable")
    doc = np.concatenate([da, dc])[order]
    unit = np.concatenate([word, sign])[order]
    shape = np.concatenate([form, sign])[order]
    n = len(unit)
    near = np.flatnonzero(doc[1:] == doc[:-1]) if n else np.empty(0, np.int64)
    pair = mix(unit[near] * np.uint64(3) + unit[near + 1]) if n else unit
    bend = mix(shape[near] * np.uint64(5) + shape[near + 1]) if n else unit
    if n:  # a word said again at once counts as one form, whichever word it is
        bend = np.where(unit[near] == unit[near + 1], _MARK, bend)
    at = np.concatenate([unit, shape, pair, bend]) >> np.uint64(64 - bits)
    who = np.concatenate([doc, doc, doc[near], doc[near]])
    return who, at.astype(np.int64), np.bincount(who, minlength=len(table))


def _upper() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[0x41:0x5B] = True
    return t


def counts(table: pa.Table, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each document's distinct feature indices and how often each occurs."""
    who, at, _ = features(table, bits)
    key, count = np.unique((who << bits) | at, return_counts=True)
    cuts = np.searchsorted(key >> bits, np.arange(len(table) + 1))
    return [(key[a:b] & ((1 << bits) - 1), count[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def weights_of(count: np.ndarray) -> np.ndarray:
    """sqrt(count), scaled to length one."""
    return np.sqrt(count / max(count.sum(), 1))


def ftrl(rows: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, int]]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias of per-coordinate follow-the-proximally-regularised-leader (McMahan et al., 2013).

    rows() goes through the examples (indices, values, label) once more at each call.
    """
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for i, v, y in rows():
            i, v = np.append(i, bias), np.append(v, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(size))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Weights fitted on at most max_train labelled rows whose crc32(id as text) mod 5 is not 0.

    Rows without id or label are left out.  The rows are fitted in one task, in the order of a hash of their ids;
    only the weights, 2^bits numbers at most, reach the driver.  Without any labelled row all weights are 0.
    """
    own = labels.select(F.col(id_col).alias("id_"), F.col(label_col).cast("int").alias("y_")).where("id_ is not null and y_ is not null")
    own = own.where(F.crc32(F.col("id_").cast("string").cast("binary")) % 5 != 0).groupBy("id_").agg(F.min("y_").alias("y_"))
    own = own.withColumn("o_", F.xxhash64("id_")).orderBy("o_", "id_").limit(max_train)
    # The chosen labels are max_train rows of three numbers at most, which bounds the broadcast.
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_")).join(F.broadcast(own), "id_")

    def vectorise(batches):
        for b in batches:
            whole = pa.Table.from_batches([b])
            for a, z in blocks(texts_of(whole)[1], BLOCK_BYTES):
                t = whole.slice(a, z - a)
                got = counts(t, bits)
                yield pa.record_batch({"o": t.column("o_").combine_chunks(), "id": t.column("id_").combine_chunks().cast(pa.int64()), "y": t.column("y_").combine_chunks(), "i": pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()), "n": pa.array([n.astype("<u4").tobytes() for _, n in got], pa.binary())})

    def learn(batches):
        seen = []

        def examples():
            for b in batches:  # in the order of epochs, one batch in memory at a time
                i, n, y = (b.column(b.schema.get_field_index(c)) for c in "iny")
                for k in range(b.num_rows):
                    seen[:] = [True]
                    yield np.frombuffer(i[k].as_buffer(), "<i4"), weights_of(np.frombuffer(n[k].as_buffer(), "<u4")), y[k].as_py()

        w, bias = ftrl(examples, bits, epochs=1)
        if seen:
            yield pa.record_batch([pa.array([w.astype("<f8").tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["w", "bias"])

    # A row for each epoch: the task that learns reads them in order and holds none of them.
    rows = rows.mapInArrow(vectorise, "o long, id long, y int, i binary, n binary").withColumn("e", F.explode(F.array(*map(F.lit, range(EPOCHS)))))
    got = rows.repartition(1).sortWithinPartitions("e", "o", "id").mapInArrow(learn, "w binary, bias double").collect()
    if not got:
        return np.zeros(1 << bits), 0.0
    return np.frombuffer(got[0][0], "<f8"), got[0][1]


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS, text_col: str = "text") -> DataFrame:
    """docs with a column score_ (0 to 1, never null): the logistic of the sparse dot product of each whole text."""
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32)), model[1]
    from pyspark.sql.types import DoubleType, StructField, StructType

    shape = StructType([*docs.schema.fields, StructField("score_", DoubleType(), False)])

    def step(batches):
        w = weights.value
        for b in batches:
            t = pa.table({"text_": b.column(b.schema.get_field_index(text_col)).cast(pa.string())})
            parts = []
            for a, z in blocks(texts_of(t)[1], BLOCK_BYTES):
                part = t.slice(a, z - a)
                who, at, _ = features(part, bits)
                n = z - a
                key, count = np.unique((who << bits) | at, return_counts=True)
                d, i = key >> bits, key & ((1 << bits) - 1)
                top = np.bincount(d, weights=np.sqrt(count) * w[i], minlength=n)
                size = np.sqrt(np.bincount(d, weights=count, minlength=n))
                parts.append(1 / (1 + np.exp(-np.clip(top / np.maximum(size, 1e-9) + bias, -35, 35))))
            s = tidy(np.concatenate(parts) if parts else np.empty(0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "score_"])

    return docs.mapInArrow(step, shape)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; score is of the text alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    return score(docs, model).select("doc_id", held, F.col("score_").alias("score"), F.when(F.col("score_") >= 0.3, 1).otherwise(0).alias("predicted"))
