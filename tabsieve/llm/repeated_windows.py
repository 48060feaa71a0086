"""Substring dedup by level-wise doubling: later occurrences of repeated word windows are removed.

A window of `window` words can be repeated only if shorter windows inside it are.  Level by level (start, 2*start,
..., window) each surviving window names the smallest-hashed gram of the level's length within it; equal windows
name equal grams, so windows whose gram occurs at one place only cannot be repeated and are dropped.  Survivors are
extended to twice the length; the search ends when none survive or the full length is reached, where whole windows
are compared by 128-bit hashes.  Only distinct hashes of each chunk are exchanged (see exchange.py).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .hashing import NOT_SPACE, Rolling, byte_values, sliding_min, words_of

_LAST = np.iinfo(np.int64).max


class _Chunk:
    """Words of a chunk and its windows that survive the levels answered so far."""

    def __init__(self, table: pa.Table, window: int):
        self.data, self.offsets = X.texts_of(table)
        self.start, self.end, self.doc = words_of(self.data, self.offsets, NOT_SPACE)
        values = byte_values(self.data)
        # Two hashes of a word from its bytes, so that words that share one differ in the other.
        self.words = tuple(Rolling(Rolling(values, k).spans(self.start, self.end), k) for k in (0, 1))
        self.window = window
        n = len(self.start)
        at = np.arange(max(0, n - window + 1))
        self.alive = at[self.doc[at] == self.doc[at + window - 1]] if len(at) else at

    def level(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct grams named by the surviving windows, and each window's place among them."""
        self.grams = self.words[0].grams(length) & ~np.uint64(1)
        named = sliding_min(self.grams, self.window - length + 1)[self.alive]
        new = np.ones(len(named), dtype=bool)
        new[1:] = named[1:] != named[:-1]
        distinct, place = np.unique(named[new], return_inverse=True)
        return distinct, place[np.cumsum(new) - 1] if len(named) else place

    def flagged(self, distinct: np.ndarray) -> np.ndarray:
        """The grams of level(), the lowest bit telling whether one occurs twice in this chunk."""
        inside = np.sort(self.grams)
        twice = inside[1:][inside[1:] == inside[:-1]]
        return distinct | np.isin(distinct, np.unique(twice)).astype(np.uint64)

    def survive(self, length: int, codes: np.ndarray) -> None:
        self.alive = self.alive[codes[self.level(length)[1]] > 0]

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Surviving windows' order by hash, and where each class of equal windows begins in it (its first window first)."""
        lo = self.words[0].spans(self.alive, self.alive + self.window)
        hi = self.words[1].spans(self.alive, self.alive + self.window)
        order = np.lexsort((hi, lo))
        lo, hi = lo[order], hi[order]
        new = np.ones(len(lo), dtype=bool)
        new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        return order, np.flatnonzero(new), np.stack([lo, hi])


def _repeated_grams(table: pa.Table) -> pa.Table:
    """Code 1 for each hash that another chunk sends too, or that its own chunk holds twice."""
    rows = X.received(table)
    hashes = [np.frombuffer(r[2], dtype=np.uint64) for r in rows]
    all_ = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    keys = all_ & ~np.uint64(1)
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    code = np.zeros(len(keys), dtype=np.uint8)
    code[order[1:][same]] = 1
    code[order[:-1][same]] = 1
    code |= (all_ & np.uint64(1)).astype(np.uint8)
    cuts = np.cumsum([0, *map(len, hashes)])
    return X.messages([(r[0], r[1], code[a:b].tobytes()) for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)])


_ENTRY = np.dtype([("lo", "<u8"), ("hi", "<u8"), ("doc", "<i8")])


def _not_first(table: pa.Table) -> pa.Table:
    """Code 1 for each window whose first occurrence is in another chunk."""
    rows = X.received(table)
    parts = [np.frombuffer(r[2], dtype=_ENTRY) for r in rows]
    e = np.concatenate(parts)
    owner = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
    order = np.lexsort((owner, e["doc"], e["hi"], e["lo"]))
    s = e[order]
    code = np.zeros(len(e), dtype=np.uint8)
    code[order[1:][(s["lo"][1:] == s["lo"][:-1]) & (s["hi"][1:] == s["hi"][:-1])]] = 1
    cuts = np.cumsum([0, *map(len, parts)])
    return X.messages([(r[0], r[1], code[a:b].tobytes()) for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)])


def levels_of(start: int, window: int) -> list[int]:
    """start, doubled while shorter than window."""
    if not 1 <= start <= window:
        raise ValueError("start must be between 1 and window")
    out = []
    while start < window:
        out.append(start)
        start *= 2
    return out


def _ask(chunk: int, keys: np.ndarray, payload: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    cuts = X.split_points(keys, buckets)
    return [(chunk, b, payload[cuts[b] : cuts[b + 1]].tobytes()) for b in range(buckets) if cuts[b + 1] > cuts[b]]


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, start: int = 5, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, removed_spans [(first word, word after last)], carry_.

    A word goes if a window of `window` words that covers it also starts earlier: in a document with a smaller id,
    or earlier in the same one.  Words are maximal runs of bytes other than ASCII white space.  Null and empty texts
    have no words.  Null ids come after all others; rows that share an id count as different documents, of which one
    is taken as the earlier.  An empty table gives an empty result.
    """
    n = X.chunk_count(docs, text_col)
    texts = X.dealt(docs, id_col, text_col, n, carry)
    levels = levels_of(start, window)
    buckets = max(12, n // 5)

    def settled(table: pa.Table, answers: pa.Table | None, done: list[int]) -> tuple[_Chunk, np.ndarray]:
        c = _Chunk(table, window)
        codes = X.answered(answers) if answers is not None else np.empty(0, np.uint8)
        held = 0
        for length in done:
            k = len(c.level(length)[0])
            c.survive(length, codes[held : held + k])
            held += k
        return c, codes[held:]

    # Answers to all earlier levels travel on: bucket numbers rise with the level, which keeps their order.
    answers = None
    for i, length in enumerate(levels):

        def ask(table, got, done=levels[:i], length=length, i=i):
            chunk = table.column("chunk_")[0].as_py() if len(table) else 0
            if not len(table):
                return X.messages([])
            c, _ = settled(table, got, done)
            keys, _ = c.level(length)
            rows = [(a, b + i * buckets, blob) for a, b, blob in _ask(chunk, keys, c.flagged(keys), buckets)]
            return X.messages(rows + [(r[0], -1 - r[1], r[2]) for r in (X.received(got) if got is not None else [])])

        def reduce(table):
            # Rows with negative buckets are earlier answers on their way back to the chunk.
            if table.column("bucket_")[0].as_py() < 0:
                return X.messages([(r[0], -1 - r[1], r[2]) for r in X.received(table)])
            return _repeated_grams(table)

        answers = X.exchange(X.per_chunk(texts, ask, X.MESSAGE, answers), reduce)

    def ask_whole(table, got):
        if not len(table):
            return X.messages([])
        chunk = table.column("chunk_")[0].as_py()
        c, _ = settled(table, got, levels)
        order, first, h = c.whole()
        ids = np.asarray(pc.fill_null(table.column("id_").combine_chunks(), _LAST))
        e = np.empty(len(first), dtype=_ENTRY)
        e["lo"], e["hi"], e["doc"] = h[0][first], h[1][first], ids[c.doc[c.alive[order[first]]]]
        rows = [(a, b + len(levels) * buckets, blob) for a, b, blob in _ask(chunk, h[0][first], e, buckets)]
        return X.messages(rows + [(r[0], -1 - r[1], r[2]) for r in (X.received(got) if got is not None else [])])

    def reduce_whole(table):
        if table.column("bucket_")[0].as_py() < 0:
            return X.messages([(r[0], -1 - r[1], r[2]) for r in X.received(table)])
        return _not_first(table)

    answers = X.exchange(X.per_chunk(texts, ask_whole, X.MESSAGE, answers), reduce_whole)

    kind = next((f.dataType for f in texts.schema.fields if f.name == "carry_"), None)
    shape = "doc_id long, n_words long, n_removed long, kept_text string, removed_spans array<struct<start:long,end:long>>" + (f", carry_ {kind.simpleString()}" if kind else "")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(table, got):
        docs_ = len(table)
        c, codes = settled(table, got, levels)
        order, first, _ = c.whole()
        later = np.ones(len(order), dtype=bool)
        later[first] = codes.astype(bool) if len(first) else False
        hit = c.alive[order[later]]
        n_words = len(c.start)
        depth = np.bincount(hit, minlength=n_words + 1) - np.bincount(hit + window, minlength=n_words + 1)
        gone = np.cumsum(depth[:n_words]) > 0
        word_at = np.searchsorted(c.doc, np.arange(docs_ + 1))
        raw = c.data.tobytes()
        kept, spans, removed = [], [], []
        for d in range(docs_):
            a, b = word_at[d], word_at[d + 1]
            words = raw[c.offsets[d] : c.offsets[d + 1]].split()
            g = gone[a:b]
            runs = []
            if g.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                runs = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                words = [w for w, out in zip(words, g, strict=True) if not out]
            kept.append(b" ".join(words).decode("utf-8", "replace"))
            spans.append(runs)
            removed.append(int(g.sum()))
        out = {"doc_id": table.column("id_"), "n_words": pa.array(np.diff(word_at), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "removed_spans": pa.array(spans, span)}
        if kind:
            out["carry_"] = table.column("carry_")
        return pa.table(out)

    return X.per_chunk(texts, cut, shape, answers)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of remove_repeated_windows() over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeated_windows(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
