"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere are removed.

Two equal strings of `length` bytes contain the same smallest-hashed gram at the same place, its anchor.  Strings
are therefore dealt to shards by their anchor: each run of strings with one anchor travels once as the stretch of
text that it covers, and only if the anchor occurs anywhere else.  Every shard sorts the suffixes of its stretches
(Larsson-Sadakane), takes common prefixes (Kasai) and so finds the classes of equal strings.  An anchor with many
occurrences is spread over several shards; their classes are then merged by binary search in sorted fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .hashing import Rolling, byte_values, least_grams, mix
from .suffix_array import common_prefixes, suffix_array

GRAM = 48
#: Occurrences of one anchor that one shard takes; an anchor with more is spread over several.
PER_SHARD = 512
_U1 = np.uint64(1)
_ASKED = np.dtype([("key", "<u8"), ("n", "u1")])
_PIECE = np.dtype([("len", "<u4"), ("starts", "<u4"), ("spread", "u1"), ("many", "u1")])
_SINGLE = np.dtype([("lo", "<u8"), ("hi", "<u8"), ("chunk", "<i4"), ("at", "<u4")])


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


class _Chunk:
    """Bytes of a chunk and its runs of neighbouring strings that have the same anchor; lengths ascend."""

    def __init__(self, table: pa.Table, lengths: tuple[int, ...]):
        self.data, self.offsets = X.texts_of(table)
        least, gram = lengths[0], min(GRAM, lengths[0])
        self.width = least - gram + 1
        self.grams, named = least_grams(self.data, gram, self.width)
        room = np.zeros(len(named), dtype=bool)
        for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True):
            if b - a >= least:
                room[a : b - least + 1] = True
        new = np.ones(len(named), dtype=bool)
        new[1:] = (named[1:] != named[:-1]) | ~room[:-1]
        self.first = np.flatnonzero(new & room)
        edge = np.append(new[1:] | ~room[1:], True) if len(room) else new
        self.last = np.flatnonzero(edge & room)
        self.anchor = named[self.first]
        # A run travels as far as its longest strings reach within its document.
        self.reach = np.minimum(self.last + lengths[-1], self.offsets[np.searchsorted(self.offsets, self.first, side="right")]) if len(self.first) else self.first

    def asked(self) -> np.ndarray:
        """Sorted distinct anchors with the number of their occurrences (255: or more)."""
        keys, place, count = np.unique(self.anchor, return_inverse=True, return_counts=True)
        twice = np.zeros(len(self.first), dtype=bool)
        for a in range(0, len(self.first), 2048):  # does an anchor stand twice within one run?
            f, t, h = self.first[a : a + 2048], self.last[a : a + 2048], self.anchor[a : a + 2048, None]
            seen = np.lib.stride_tricks.sliding_window_view(self.grams, self.width)
            left = f + (seen[f] == h).argmax(1)
            right = t + self.width - 1 - (seen[t] == h)[:, ::-1].argmax(1)
            twice[a : a + 2048] = left != right
        count[place[twice]] += 1
        out = np.empty(len(keys), dtype=_ASKED)
        out["key"], out["n"] = keys, np.minimum(count, 255)
        return out

    def pieces(self, keys: np.ndarray, codes: np.ndarray, chunk: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs whose anchor occurs elsewhere: number, shard, spread flag and order by shard."""
        code = codes[np.searchsorted(keys, self.anchor)] if len(keys) else np.empty(0, np.uint8)
        run = np.flatnonzero(code)
        spread = code[run] > 1
        salt = mix(np.uint64(chunk) * np.uint64(1 << 32) + np.arange(len(run), dtype=np.uint64)) & ((_U1 << (code[run].astype(np.uint64) - _U1)) - _U1)
        shard = X.bucket_of(np.where(spread, mix(self.anchor[run] + salt), mix(self.anchor[run])), shards)
        order = np.argsort(shard, kind="stable")
        return run[order], shard[order], spread[order], order


def _codes(table: pa.Table) -> pa.Table:
    """Per anchor: 0 if it occurs once, else 1 + the logarithm of the number of shards it is spread over."""
    rows = X.received(table)
    parts = [np.frombuffer(r[2], dtype=_ASKED) for r in rows]
    e = np.concatenate(parts)
    keys, place = np.unique(e["key"], return_inverse=True)
    total = np.bincount(place, weights=e["n"], minlength=len(keys))
    code = np.where(total < 2, 0, 1 + np.ceil(np.log2(np.maximum(total / PER_SHARD, 1)))).astype(np.uint8)[place]
    cuts = np.cumsum([0, *map(len, parts)])
    return X.messages([(r[0], r[1], code[a:b].tobytes()) for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)])


def _shard(table: pa.Table, lengths: tuple[int, ...], merge_buckets: int) -> pa.Table:
    """Finds equal strings among a shard's pieces.

    Out: to each chunk, a bit per string it sent and length (1: occurs again); for spread anchors also, to the merge,
    the fingerprint of each class of equal strings, and of single ones who sent them.
    """
    rows = X.received(table)
    texts: list[bytes] = []
    known: dict[bytes, int] = {}
    starts, spread, many, who = [], [], [], []  # by distinct piece; by piece sent: (row, distinct piece)
    for k, (_, _, blob) in enumerate(rows):
        raw = _expand(blob)
        n = int.from_bytes(raw[:4], "little")
        head = np.frombuffer(raw, dtype=_PIECE, count=n, offset=4)
        at = 4 + n * _PIECE.itemsize
        for size, held, wide, more in head.tolist():
            piece = raw[at : at + size]
            at += size
            d = known.setdefault(piece, len(texts))
            if d == len(texts):
                texts.append(piece)
                starts.append(held)
                spread.append(bool(wide))
                many.append(bool(more))
            else:
                many[d] = True
                spread[d] |= bool(wide)
            who.append((k, d))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    piece_of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    sa, _ = suffix_array(data)
    lcp = common_prefixes(data, sa)
    weight = 1 + np.array(many, dtype=np.int64)
    again = np.zeros((len(lengths), len(data)), dtype=bool)
    classes = []
    for w, length in enumerate(lengths):
        begins = np.zeros(len(data), dtype=bool)  # places where a string of this length begins
        for x, held, size in zip(begin.tolist(), starts, sizes.tolist(), strict=False):
            begins[x : x + min(held, max(size - length + 1, 0))] = True
        ok = begins[sa]
        member, klass = sa[ok], np.cumsum(lcp < length)[ok]
        first = np.flatnonzero(np.diff(klass, prepend=-1))
        if len(member):
            several = np.add.reduceat(weight[piece_of[member]], first) >= 2
            again[w, member] = np.repeat(several, np.diff(first, append=len(member)))
        classes.append(member[first])

    out: list[tuple[int, int, bytes]] = []
    sent: dict[int, list[int]] = {}
    for k, d in who:
        sent.setdefault(k, []).append(d)
    ordinal: dict[int, tuple[int, int]] = {}
    for k, ds in sent.items():
        bits, at = [], 0
        for d in ds:
            ordinal.setdefault(d, (k, at))
            bits.append(again[:, begin[d] : begin[d] + starts[d]].T.ravel())
            at += starts[d]
        out.append((rows[k][0], rows[k][1], b"B" + _squeeze(np.packbits(np.concatenate(bits)).tobytes())))

    if any(spread):
        owner = np.array([ordinal[d] for d in range(len(texts))], dtype=np.int64)
        chunks = np.array([r[0] for r in rows], dtype=np.int64)
        values = byte_values(data)
        rolling = Rolling(values, 0), Rolling(mix(values), 1)
        fingers = []
        wide = np.array(spread, dtype=bool)
        for w, m in enumerate(classes):
            m, length = m[wide[piece_of[m]]], lengths[w]
            finger = np.empty(len(m), dtype=_SINGLE)
            finger["lo"] = mix(rolling[0].spans(m, m + length) + np.uint64(length))
            finger["hi"] = rolling[1].spans(m, m + length)
            d = piece_of[m]
            finger["chunk"] = np.where(again[w, m], -1, chunks[owner[d, 0]])
            finger["at"] = (owner[d, 1] + (m - begin[d])) * len(lengths) + w
            fingers.append(finger)
        finger = np.concatenate(fingers)
        finger = finger[np.argsort(finger["lo"])]
        bucket = X.bucket_of(finger["lo"], merge_buckets)
        cuts = np.searchsorted(bucket, np.arange(merge_buckets + 1))
        for b in range(merge_buckets):
            if cuts[b + 1] > cuts[b]:
                out.append((-1 - b, rows[0][1], b"F" + _squeeze(finger[cuts[b] : cuts[b + 1]].tobytes())))
    return X.messages(out)


def _whole(finger: np.ndarray) -> np.ndarray:
    """Fingerprints as strings of sixteen bytes, which sort and compare as a whole."""
    pair = np.empty((len(finger), 2), dtype=">u8")
    pair[:, 0], pair[:, 1] = finger["lo"], finger["hi"]
    return pair.view("S16").ravel()


def _merge(table: pa.Table) -> pa.Table:
    """Passes bits on; looks every shard's fingerprints up in those of all shards by binary search."""
    if table.column("chunk_")[0].as_py() >= 0:
        return table.select(["chunk_", "bucket_", "blob_"])
    rows = X.received(table)
    runs = [(r[1], np.frombuffer(_expand(r[2][1:]), dtype=_SINGLE)) for r in rows]
    every = np.sort(np.concatenate([_whole(f) for _, f in runs]))
    out: list[tuple[int, int, bytes]] = []
    for shard, f in runs:
        single = f[f["chunk"] >= 0]
        key = _whole(single)
        elsewhere = single[np.searchsorted(every, key, side="right") - np.searchsorted(every, key, side="left") >= 2]
        for c in np.unique(elsewhere["chunk"]):
            out.append((int(c), shard, b"S" + elsewhere["at"][elsewhere["chunk"] == c].astype("<u4").tobytes()))
    return X.messages(out)


def _covered(flags: np.ndarray, length: int) -> np.ndarray:
    """Bytes covered by a string of `length` bytes from a flagged place on."""
    seen = np.concatenate([np.zeros(length, np.int32), np.cumsum(flags, dtype=np.int32)])
    return seen[length:] > seen[: len(flags)]


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, carry: list[str] | None = None, as_text: bool = False, passage: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary; with as_text a string, without characters of which a byte goes), removed_spans [(first, after last)], carry_.

    Texts are taken as UTF-8 bytes (null: empty).  A byte goes if a string of `length` bytes that covers it also
    starts anywhere else, in the same document or another; overlaps count, and strings are judged on the input.
    All occurrences go.  Rows that share an id or text are different documents.  An empty table gives no rows.
    With `passage`, a shorter length, the same suffix arrays also give passage_spans and without_passages: the text
    (string) without the characters of repeated strings of that length.
    """
    lengths = (length,) if passage is None else (passage, length)
    if lengths[0] < 16 or lengths[0] > length:
        raise ValueError("length must be at least 16, and passage between 16 and length")
    n = X.chunk_count(docs, text_col)
    texts = X.dealt(docs, id_col, text_col, n, carry)
    buckets, shards, merges = max(12, n // 8), n, max(12, n // 4)

    def ask(table, _):
        if not len(table):
            return X.messages([])
        chunk = table.column("chunk_")[0].as_py()
        e = _Chunk(table, lengths).asked()
        cuts = X.split_points(e["key"], buckets)
        return X.messages([(chunk, b, e[cuts[b] : cuts[b + 1]].tobytes()) for b in range(buckets) if cuts[b + 1] > cuts[b]])

    codes = X.exchange(X.per_chunk(texts, ask, X.MESSAGE), _codes)

    def chosen(table, got):
        c = _Chunk(table, lengths)
        chunk = table.column("chunk_")[0].as_py() if len(table) else 0
        keys = np.unique(c.anchor)
        return c, chunk, c.pieces(keys, X.answered(got), chunk, shards)

    def stretches(table, got):
        """Pieces by shard; then, from bucket -1 on, the codes again for the last pass."""
        if not len(table):
            return X.messages([])
        c, chunk, (run, shard, spread, _) = chosen(table, got)
        raw = c.data.tobytes()
        out = [(r[0], -1 - r[1], r[2]) for r in X.received(got)]
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.empty(0, int)
        edges = np.append(cuts, len(shard))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            known: dict[bytes, int] = {}
            count: list[int] = []
            held: list[int] = []
            wide: list[bool] = []
            for k in range(a, b):
                piece = raw[c.first[run[k]] : c.reach[run[k]]]
                d = known.setdefault(piece, len(count))
                if d == len(count):
                    count.append(1)
                    held.append(int(c.last[run[k]] - c.first[run[k]]) + 1)
                    wide.append(bool(spread[k]))
                else:
                    count[d] += 1
                    wide[d] |= bool(spread[k])
            head = np.empty(len(count), dtype=_PIECE)
            head["len"], head["starts"], head["spread"], head["many"] = [len(p) for p in known], held, wide, [x > 1 for x in count]
            out.append((chunk, int(shard[a]), _squeeze(len(count).to_bytes(4, "little") + head.tobytes() + b"".join(known))))
        return X.messages(out)

    def shard_step(table):
        if table.column("bucket_")[0].as_py() < 0:
            return X.messages([(r[0], r[1], b"C" + r[2]) for r in X.received(table)])
        return _shard(table, lengths, merges)

    found = X.exchange(X.per_chunk(texts, stretches, X.MESSAGE, codes), shard_step)
    # Fingerprints by range (negative); bits on their way to a chunk in groups as many.
    to = F.when(F.col("chunk_") < 0, F.col("chunk_")).otherwise(F.pmod("chunk_", F.lit(merges)))
    found = found.groupBy(to.alias("to_")).applyInArrow(lambda _, t: X.tidy(_merge(t)), X.MESSAGE)

    kind = next((f.dataType for f in texts.schema.fields if f.name == "carry_"), None)
    spans_of = "array<struct<start:long,end:long>>"
    shape = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, removed_spans {spans_of}"
    shape += (f", passage_spans {spans_of}, without_passages string" if passage else "") + (f", carry_ {kind.simpleString()}" if kind else "")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def taken_out(c: _Chunk, flags: np.ndarray, size: int, whole: bool) -> tuple[list, list[bytes], list[int]]:
        """By document: spans covered by the flagged strings, what is left (if asked for, of whole characters), and how many bytes go."""
        gone, raw = _covered(flags, size), c.data.tobytes()
        drop = gone
        if whole and gone.any():
            drop, inside = gone.copy(), (c.data & 0xC0) == 0x80  # bytes after the first of a character
            for _ in range(3):
                drop[1:] |= drop[:-1] & inside[1:]
            for _ in range(3):
                drop[:-1] |= drop[1:] & inside[1:]
        spans, kept, removed = [], [], []
        for a, b in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True):
            g = gone[a:b]
            out = int(np.count_nonzero(g))
            if out:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(c.data[a:b][~drop[a:b]].tobytes())
            else:
                spans.append([])
                kept.append(raw[a:b])
            removed.append(out)
        return spans, kept, removed

    def cut(table, got):
        parts = X.received(got)
        codes_ = [(r[0], -1 - r[1], r[2][1:]) for r in parts if r[2][:1] == b"C"]
        c, _, (run, shard, _, _) = chosen(table, X.messages(codes_))
        bits = {r[1]: np.unpackbits(np.frombuffer(_expand(r[2][1:]), np.uint8)) for r in parts if r[2][:1] == b"B"}
        for r in parts:
            if r[2][:1] == b"S":
                bits[r[1]][np.frombuffer(r[2], dtype="<u4", offset=1)] = 1
        raw = c.data.tobytes()
        flags = np.zeros((len(lengths), len(c.data)), dtype=np.uint8)
        at, seen, last, own = 0, {}, -1, None
        for to, a, b, reach in zip(shard.tolist(), c.first[run].tolist(), (c.last[run] + 1).tolist(), c.reach[run].tolist(), strict=True):
            if to != last:
                at, seen, last = 0, {}, to
                own = bits[to][: len(bits[to]) // len(lengths) * len(lengths)].reshape(-1, len(lengths)).T
            piece = raw[a:reach]
            if piece not in seen:
                seen[piece] = at
                at += b - a
            k = seen[piece]
            flags[:, a:b] = own[:, k : k + b - a]
        text = lambda kept: pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())
        spans, kept, removed = taken_out(c, flags[-1], length, as_text)
        out = {"doc_id": table.column("id_"), "n_bytes": pa.array(np.diff(c.offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()), "kept": text(kept) if as_text else pa.array(kept, pa.binary()), "removed_spans": pa.array(spans, span)}
        if passage:
            spans, kept, _ = taken_out(c, flags[0], passage, True)
            out |= {"passage_spans": pa.array(spans, span), "without_passages": text(kept)}
        if kind:
            out["carry_"] = table.column("carry_")
        return pa.table(out)

    return X.per_chunk(texts, cut, shape, found)


#: Bytes of a passage: fifty words of five bytes each, their spaces included.
PASSAGE = 250


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of remove_repeated_strings() over all documents; text is what is left without repeated passages of PASSAGE bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeated_strings(docs, passage=PASSAGE)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"), F.col("without_passages").alias("text"))
