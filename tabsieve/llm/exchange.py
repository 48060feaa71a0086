"""Exchange of compact messages between chunks of a corpus and hash ranges.

A corpus is dealt into chunks of about two megabytes by a hash of a row number, so no source or key can make a
chunk large.  Operators on repeated strings send, from each chunk to each hash range, one binary row with the
distinct hashes it holds; the range answers with one code per hash, in the order sent.  A hash therefore travels
once per chunk, however often it occurs there.  The exchange of the texts is part of the plan and is reused by
all its passes; a lost executor costs the recomputation of its partitions only.
"""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 2_000_000
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def text_bytes(df: DataFrame, column: str) -> int:
    return int(df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def chunk_count(df: DataFrame, column: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Chunks of about chunk_bytes each, and enough of them for every shuffle partition."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(text_bytes(df, column) / chunk_bytes))


def dealt(df: DataFrame, id_col: str, text_col: str, n: int, carry: list[str] | None = None) -> DataFrame:
    """Columns chunk_, id_, text_ and, if asked for, carry_ (a struct of other columns), placed by chunk."""
    cols = [F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry_"))
    df = df.select(*cols).withColumn("chunk_", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 4)
    return df.repartition(parts, "chunk_")


def texts_of(table: pa.Table, column: str = "text_") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (null: empty)."""
    col = table.column(column)
    col = pc.fill_null(col, "") if len(col) else col
    arr = (col.chunk(0) if col.num_chunks == 1 else col.combine_chunks()) if len(col) else pa.array([], pa.string())  # one chunk is read where it lies
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.chunk(0) if arr.num_chunks else pa.array([], pa.string())
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    bufs = arr.buffers()
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[off[0] : off[-1]] if bufs[2] else np.empty(0, np.uint8)
    return data, off - off[0]


def blocks(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes of text each, one row at least."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        z = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1))
        out.append((a, z))
        a = z
    return out


def by_id(table: pa.Table) -> pa.Table:
    """Rows by ascending id, null ids last; equal ids by their text, so that every pass sees the same order."""
    return table.take(pc.sort_indices(table, sort_keys=[("id_", "ascending"), ("text_", "ascending")])) if len(table) else table


def split_points(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the equal ranges of a sorted uint64 array begins."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The range each uint64 falls in, as by split_points()."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.searchsorted(edges, keys, side="right")


MESSAGE = "chunk_ int, bucket_ int, blob_ binary"
MESSAGE_ARROW = pa.schema([("chunk_", pa.int32()), ("bucket_", pa.int32()), ("blob_", pa.binary())])


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"chunk_": pa.array([r[0] for r in rows], pa.int32()), "bucket_": pa.array([r[1] for r in rows], pa.int32()), "blob_": pa.array([r[2] for r in rows], pa.binary())}, schema=MESSAGE_ARROW)


def received(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """Messages by (bucket, chunk)."""
    d = table.select(["chunk_", "bucket_", "blob_"]).to_pydict()
    return sorted(zip(d["chunk_"], d["bucket_"], d["blob_"], strict=True), key=lambda r: (r[1], r[0]))


def answered(table: pa.Table) -> np.ndarray:
    """A chunk's answers, one code per hash, over all ranges in their order."""
    got = received(table)
    return np.frombuffer(b"".join(r[2] for r in got), dtype=np.uint8)


def tidy(result=None):
    """Gives freed memory back to the system, for the task that runs in this worker next; returns its argument."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
    return result


def exchange(sent: DataFrame, reduce, shape: str = MESSAGE) -> DataFrame:
    """Groups messages by hash range; reduce gets and returns Arrow tables."""
    return sent.groupBy("bucket_").applyInArrow(lambda t: tidy(reduce(t)), shape)


def per_chunk(texts: DataFrame, step, shape: str, answers: DataFrame | None = None) -> DataFrame:
    """Runs step(texts, answers) for each chunk."""
    if answers is None:
        return texts.groupBy("chunk_").applyInArrow(lambda t: tidy(step(by_id(t), None)), shape)
    return texts.groupBy("chunk_").cogroup(answers.groupBy("chunk_")).applyInArrow(lambda t, a: tidy(step(by_id(t), a)), shape)
