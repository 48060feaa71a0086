"""Packing into fixed-length sequences: shortest-pack-first over the histogram of lengths.

Only the histogram (at most max_len numbers) reaches the driver.  There, lengths are placed longest first, each into
the packs with most room left, and counts of packing patterns are updated; patterns come to twice max_len at most.
Pieces then find their pattern by their rank among the pieces of their length.  Ranks are counted in parts, so that
one very common length is no bottleneck.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import saved
from .exchange import blocks, texts_of, tidy
from .hashing import LOWER, NOT_SPACE, Rolling, byte_values, mix, words_of

MAX_LEN = 2048
END_ID = 1
#: Words of more bytes are told apart by their bytes.
LONG = 64
#: Texts that are encoded together: what a block needs besides is about a hundred times its bytes.
BLOCK_BYTES = 500_000
#: Words whose ids a worker keeps between blocks: the first ones, and later ones at a time.
KEPT_WORDS, LATER_WORDS = 400_000, 100_000
_CACHE: dict[bytes, bytes] = {}
_LATER: dict[bytes, bytes] = {}
_TOKENIZERS: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS.clear()
        _CACHE.clear()
        _LATER.clear()
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _encode_fresh(words: list[bytes], tok) -> dict[bytes, bytes]:
    """Ids of each word.  Words of letters alone are encoded together and parted where a token ends a word."""
    texts = [w.decode("utf-8") for w in words]
    out: dict[bytes, bytes] = {}
    if "direct" not in _TOKENIZERS:
        _TOKENIZERS["direct"] = all([t.id for t in tok.model.tokenize(w)] == tok.encode(w, add_special_tokens=False).ids for w in ("the", "tokenizer", "qxzvw"))
    if _TOKENIZERS["direct"]:  # lower-case ASCII letters pass the steps before the model as they are
        split = tok.model.tokenize
        out = {w: np.array([p.id for p in split(t)], dtype="<u4").tobytes() for w, t in zip(words, texts, strict=True) if w.isalpha() and w.islower() and len(w) <= 64}
    plain = [w not in out and t.isalpha() and len(t) <= 64 for w, t in zip(words, texts, strict=True)]
    letters = [w for w, p in zip(words, plain, strict=True) if p]
    if letters:
        if "ends" not in _TOKENIZERS:
            size = tok.get_vocab_size()
            _TOKENIZERS["ends"] = np.array([tok.id_to_token(i).endswith("</w>") for i in range(size)])
        ids = np.array(tok.encode_batch_fast([b" ".join(letters).decode("utf-8")], add_special_tokens=False)[0].ids, dtype="<u4")
        stop = 4 * (np.flatnonzero(_TOKENIZERS["ends"][ids]) + 1)
        if len(stop) == len(letters):
            raw, start = ids.tobytes(), 0
            for w, end in zip(letters, stop.tolist(), strict=True):
                out[w] = raw[start:end]
                start = end
    rest = [(w, t) for w, t in zip(words, texts, strict=True) if w not in out]
    got = tok.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
    out.update((w, np.array(e.ids, dtype="<u4").tobytes()) for (w, _), e in zip(rest, got, strict=True))
    return out


def _ids_of(words: list[bytes], tok) -> list[bytes]:
    """Ids of distinct words, kept between calls: the first KEPT_WORDS, and LATER_WORDS of later ones at a time."""
    get, later = _CACHE.get, _LATER.get
    out = [get(w) for w in words]
    missing = {w for w, i in zip(words, out, strict=True) if i is None}
    if not missing:
        return out
    known = {w: i for w in missing if (i := later(w)) is not None}
    missing -= known.keys()
    ends = {w for w in missing if w[-1] in b".," and w[-2:-1].isalpha()}
    cores = {w[:-1] for w in ends} | (missing - ends)
    own = {w: i for w in cores if (i := get(w)) is not None or (i := later(w)) is not None}
    own.update(_encode_fresh([w for w in cores if w not in own] + [b".", b","], tok))
    own.update([(w, own[w[:-1]] + own[w[-1:]]) for w in ends])
    if len(_LATER) > LATER_WORDS:
        _LATER.clear()
    store = _CACHE if len(_CACHE) < KEPT_WORDS else _LATER
    store.update((w, i) for w, i in own.items() if len(w) <= 64)
    known.update(own)
    return [known[w] if i is None else i for w, i in zip(words, out, strict=True)]


def encode_texts(data: np.ndarray, offsets: np.ndarray, path: str) -> list[np.ndarray]:
    """Ids of texts that lie end to end as UTF-8 bytes, for tokenizers that lower-case and that part words at ASCII
    white space and letters from a following full stop or comma.  Each distinct word is looked up once; words of up to
    LONG bytes are distinguished by 64-bit hashes within a batch of texts, longer ones by their bytes."""
    tok = _tokenizer(path)
    data = LOWER[data]
    start, end, doc = words_of(data, offsets, NOT_SPACE)
    raw, hashed = data.tobytes(), Rolling(byte_values(data)).spans(start, end)
    known: dict[bytes, int] = {}
    long = np.flatnonzero(end - start > LONG)  # long words could be built to collide: by their bytes
    hashed[long] = mix(np.array([known.setdefault(raw[start[k] : end[k]], len(known)) for k in long.tolist()], dtype=np.uint64))
    _, first, place = np.unique(hashed, return_index=True, return_inverse=True)
    ids = _ids_of([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], tok)
    size = np.array([len(i) for i in ids], dtype=np.int64) >> 2
    begin = np.cumsum(size) - size
    n = size[place]
    stop = np.cumsum(n)
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    out = flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin[place] - (stop - n), n)]
    cut = np.concatenate([[0], stop])[np.searchsorted(doc, np.arange(len(offsets)))]
    return [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def encode_words(text: bytes, path: str) -> bytes:
    return encode_texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]), path)[0].tobytes()


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of at most max_len of every whole text (null: empty) and its closing id 1, cut every max_len ids."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches):
        for b in batches:
            data, offsets = texts_of(pa.Table.from_batches([b]), "text")
            for a, z in blocks(offsets, BLOCK_BYTES):  # a block's ids go before the next is read
                cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                ids_of = encode_texts(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], tokenizer)
                for doc, own in zip(b.column(0).slice(a, z - a).to_pylist(), ids_of, strict=True):
                    ids = own.tobytes() + end
                    n = len(ids) // 4
                    for s in range(0, n, max_len):
                        part = ids[4 * s : 4 * (s + max_len)]
                        for k, v in (("doc_id", doc), ("start", s), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part)), ("doc_tokens", n)):
                            cols[k].append(v)
                        if with_ids:
                            cols["ids"].append(np.frombuffer(part, "<u4"))
                out = {k: pa.array(cols[k], pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int64) for x in cols["ids"]], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)
            tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


def patterns(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[list[tuple[int, int]], int]]:
    """Packing patterns [(length, how many)] and their counts, by shortest pack first.

    Lengths go longest first; each goes to the packs with the most room that it fits, as many as there are of that
    pattern, which changes the pattern and its room; what fits nowhere opens new packs.
    """
    packs: dict[int, list[list]] = {}  # room left: [(contents, count)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        moved: list[tuple[int, list]] = []
        while left:
            room = max((r for r in packs if r >= length and packs[r]), default=None)
            if room is None:
                fit = min(max_len // length, left)
                whole, rest = divmod(left, fit)
                moved.append((max_len - fit * length, [[(length, fit)], whole]))
                if rest:
                    moved.append((max_len - rest * length, [[(length, rest)], 1]))
                break
            contents, count = packs[room].pop()
            fit = min(room // length, left)
            use = min(count, left // fit)
            if count > use:
                packs[room].append([contents, count - use])
            moved.append((room - fit * length, [[*contents, (length, fit)], use]))
            left -= use * fit
        for room, pack in moved:
            packs.setdefault(room, []).append(pack)
    return [(contents, count) for room in sorted(packs) for contents, count in packs[room]]


def ranked(rows: DataFrame, part_rows: int = 20_000) -> DataFrame:
    """rows with rank_, from 0, among those of equal length; no task sorts more than a part of them."""
    parts = max(64, rows.count() // part_rows)
    rows = rows.withColumn("part_", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    before = rows.groupBy("length", "part_").agg(F.count("*").alias("n_"))
    before = before.withColumn("before_", F.coalesce(F.sum("n_").over(Window.partitionBy("length").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "part_", "before_")
    own = F.row_number().over(Window.partitionBy("length", "part_").orderBy("doc_id", "start", "ids_crc32")) - 1
    return rows.withColumn("own_", own).join(before, ["length", "part_"]).withColumn("rank_", F.col("before_") + F.col("own_")).drop("part_", "own_", "before_")


def pack(rows: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Pieces with sequence_id and offset: every piece in one sequence, gapless from 0, at most max_len in each.

    rows need doc_id, start, length (1 to max_len) and ids_crc32 and are read more than once; an empty table gives
    no rows.
    """
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}  # at most max_len rows
    slots = []  # (length, sequences, per sequence, first sequence, offset)
    base = 0
    for contents, count in patterns(counts, max_len):
        offset = 0
        for length, fit in contents:
            slots.append((length, count, fit, base, offset))
            offset += length * fit
        base += count
    slots.sort()
    s = np.array(slots, dtype=np.int64).reshape(-1, 5)
    used = s[:, 1] * s[:, 2]
    first = np.cumsum(used) - used
    if len(s):
        new = np.append(True, s[1:, 0] != s[:-1, 0])
        first -= first[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
    table = rows.sparkSession.sparkContext.broadcast((s, first))  # two slots a length in each of the patterns

    def place(batches):
        s, first = table.value
        key = (s[:, 0] << 48) | first
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "rank_"))
            k = np.searchsorted(key, (length << 48) | rank, side="right") - 1
            within = rank - first[k]
            names = [n for n in b.schema.names if n != "rank_"]
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s[k, 3] + within // s[k, 2]), pa.array(s[k, 4] + within % s[k, 2] * length)], names=[*names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    shape = StructType([*rows.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked(rows).select(*rows.columns, F.col("rank_").cast("long").alias("rank_")).mapInArrow(place, shape)


def op8_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(saved(pieces(docs, tokenizer or default_tokenizer())))
