"""Repeated word windows and byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabsieve.llm import exchange, repeated_strings
from tabsieve.llm import suffix_array as suffix_arrays
from tabsieve.llm.hashing import NOT_SPACE, Rolling, byte_values, sliding_min, words_of
from tabsieve.llm.repeated_strings import remove_repeated_strings
from tabsieve.llm.repeated_windows import levels_of, remove_repeated_windows
from tabsieve.llm.suffix_array import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string"


def corpus(seed: int, n: int = 90) -> list[tuple]:
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(["aa", "b", "çc", "dd", "e."]) for _ in range(rnd.randint(5, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        t = " ".join(rnd.choice(base) for _ in range(rnd.randint(0, 5)))
        t = rnd.choice([t, t, t, "ab " * rnd.randint(1, 60), "", None, " \t\n", "x" * 300])
        rows.append((i, t))
    return rows


def brute_windows(rows, w):
    seen, out = set(), {}
    for d, t in sorted(rows):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - w + 1):
            k = tuple(words[i : i + w])
            if k in seen:
                gone[i : i + w] = [True] * w
            seen.add(k)
        out[d] = (len(words), sum(gone), b" ".join(x for x, g in zip(words, gone, strict=True) if not g).decode())
    return out


def brute_strings(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window,start", [(20, 5), (7, 3), (4, 4), (1, 1)])
def test_windows_match_brute_force(spark, window, start):
    rows = corpus(window)
    got = remove_repeated_windows(spark.createDataFrame(rows, SCHEMA), window=window, start=start).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == brute_windows(rows, window)
    for r in got:
        assert sum(e - s for s, e in r["removed_spans"]) == r["n_removed"]


def test_windows_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(None, t), (5, t), (5, t), (2, t), (1, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", chunk_ int, id_ int")
    got = sorted(((r["doc_id"] or 99, r["n_removed"]) for r in remove_repeated_windows(df).collect()))
    assert got == [(1, 0), (2, 0), (5, 30), (5, 30), (99, 30)]
    assert remove_repeated_windows(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        levels_of(30, 20)


def test_strings_match_brute_force(spark, monkeypatch):
    rows = corpus(3)
    df = spark.createDataFrame(rows, SCHEMA)

    def digest(out):
        return sorted(tuple(r) for r in out.select("n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())

    assert digest(remove_repeated_strings(df, length=40)) == brute_strings(rows, 40)
    # anchors spread over several shards: classes are merged by binary search
    monkeypatch.setattr(repeated_strings, "PER_SHARD", 2)
    assert digest(remove_repeated_strings(df, length=64)) == brute_strings(rows, 64)


def test_passages_of_a_shorter_length(spark, monkeypatch):
    rows = corpus(5)
    df = spark.createDataFrame(rows, SCHEMA)
    for most in (512, 2):  # with 2, anchors are spread over several shards
        monkeypatch.setattr(repeated_strings, "PER_SHARD", most)
        out = remove_repeated_strings(df, length=64, passage=30).collect()
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out) == brute_strings(rows, 64)
        assert sorted((r["n_bytes"], sum(s["end"] - s["start"] for s in r["passage_spans"]), len(r["passage_spans"])) for r in out) == [x[:3] for x in brute_strings(rows, 30)]
        assert all("\ufffd" not in r["without_passages"] for r in out)
    with pytest.raises(ValueError):
        remove_repeated_strings(df, length=64, passage=65)


def test_strings_of_rows_with_equal_ids(spark):
    """Rows of one id or none, in another order at every pass."""
    rows = [(rid, t) for (_, t), rid in zip(corpus(9, 400), [None, 7] * 200, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = remove_repeated_strings(df, length=40).select("n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(tuple(r) for r in out.collect()) == brute_strings(rows, 40)
    t = exchange.pa.table({"id_": exchange.pa.array([7, None, 7, 2]), "text_": ["b", "c", "a", None]})
    want = exchange.by_id(t).to_pydict()
    assert want == {"id_": [2, 7, 7, None], "text_": [None, "a", "b", "c"]}
    assert exchange.by_id(t.take([3, 2, 1, 0])).to_pydict() == want


def test_suffix_array_in_slices(monkeypatch):
    monkeypatch.setattr(suffix_arrays, "SLICE", 16)
    data = np.frombuffer(b"abcab" * 60 + bytes(50) + b"abcabd" * 20, dtype=np.uint8)
    b = data.tobytes()
    assert suffix_array(data)[0].tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_strings_odd_rows(spark):
    t = "".join(f"word{i} " for i in range(90))
    df = spark.createDataFrame([(1, t, "k"), (None, t, "l"), (1, None, None), (4, "", "m")], SCHEMA + ", carry_ string")
    got = {r["carry_"]["carry_"]: r["n_removed"] for r in remove_repeated_strings(df, carry=["carry_"]).collect()}
    assert got == {"k": len(t), "l": len(t), None: 0, "m": 0}
    assert remove_repeated_strings(df.limit(0)).count() == 0
    one = remove_repeated_strings(spark.createDataFrame([(1, "é" * 500)], SCHEMA), length=401, as_text=True).first()
    assert one["n_bytes"] == 1000 and set(one["kept"]) <= {"é"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=0, max_size=60))
def test_suffix_array(values):
    data = np.array(values, dtype=np.uint8)
    b = data.tobytes()
    sa, _ = suffix_array(data)
    assert list(sa) == sorted(range(len(b)), key=lambda i: b[i:])
    lcp = common_prefixes(data, sa)
    for k in range(1, len(b)):
        x, y = b[sa[k - 1] :], b[sa[k] :]
        assert lcp[k] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \t\né", max_size=12), min_size=1, max_size=5))
def test_words_and_hashes(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    start, end, doc = words_of(data, offsets, NOT_SPACE)
    got = [(int(d), data[a:b].tobytes()) for a, b, d in zip(start, end, doc, strict=True)]
    assert got == [(k, w) for k, t in enumerate(raw) for w in t.split()]
    hashed = Rolling(byte_values(data)).spans(start, end)
    assert len(set(hashed.tolist())) == len({w for _, w in got})
    x = np.frombuffer(b"".join(raw) or b"\0", dtype=np.uint8)
    for w in (1, 2, 3):
        assert sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]
