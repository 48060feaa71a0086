"""Vector links, shingle classes, components and decontamination against brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from tabsieve.llm import decontamination, ngram_join, vector_links
from tabsieve.llm.components import components
from tabsieve.llm.decontamination import contaminated
from tabsieve.llm.ngram_join import shingle_classes
from tabsieve.llm.prefix_tree import Union, link
from tabsieve.llm.vector_links import linked_vectors

SCHEMA = "doc_id long, text string"


def classes(n, pairs):
    u = Union(n)
    for a, b in pairs:
        u.join(a, b)
    return [u.find(i) for i in range(n)]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(0, k) for k in range(400, 700)] + [(k, k + 1) for k in range(700, 760)]
    got = dict(components(spark.createDataFrame([*edges, (5, 5), (None, 3)], "u long, v long")).collect())
    want = classes(800, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_prefix_tree():
    rnd = random.Random(2)
    for _ in range(80):
        base = [sorted(rnd.sample(range(40), rnd.randint(1, 40))) for _ in range(3)]
        sets = []
        for _ in range(rnd.randint(1, 20)):
            b = set(rnd.choice(base))
            for _ in range(rnd.randint(0, 4)):
                b ^= {rnd.randrange(40)}
            sets.append(np.array(sorted(b or {0})))
        u = link(sets, range(len(sets)), range(len(sets)))
        s = [set(x.tolist()) for x in sets]
        pairs = [(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
        assert [u.find(i) for i in range(len(s))] == classes(len(s), pairs)


@pytest.mark.parametrize("block", [3, 2048])
def test_shingle_classes(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rnd = random.Random(3)
    base = [[f"W{rnd.randint(0, 400)}" for _ in range(rnd.randint(3, 60))] for _ in range(8)]
    rows = []
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = f"w{rnd.randint(0, 500)}"
        rows.append((i, " ".join(w) if i % 17 else rnd.choice([None, "", " "])))
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    pairs = [(i, j) for i in range(150) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    got = {r[0]: (r[1], r[2]) for r in shingle_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = classes(150, pairs)
    assert got == {i: (len(sets[i]), want[i]) for i in range(150)}


def test_chains_of_boilerplate_grow_in_proportion(spark, monkeypatch):
    """Documents of a line and the next one: one group, but tasks only for the documents that share a line."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    shipped = []
    for n in (240, 480):
        lines = [" ".join(f"l{i}w{k}" for k in range(12)) for i in range(n + 1)]
        rows = [(i, f"{lines[i]} {lines[i + 1]}") for i in range(n)] + [(1000, lines[5] + " " + lines[6] + " end")]
        held = []
        real = ngram_join.cells
        monkeypatch.setattr(ngram_join, "cells", lambda t, g, real=real, held=held: held.append(real(t, g)) or held[-1])
        got = {r[0]: r[2] for r in shingle_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
        monkeypatch.setattr(ngram_join, "cells", real)
        assert got == {**{i: i for i in range(n)}, 1000: 5}
        sizes = [r[0] for r in held[0].groupBy("component", "cell").count().select("count").collect()]
        assert max(sizes) <= 8
        shipped.append(sum(sizes))
    assert shipped[1] <= 2.2 * shipped[0]


def test_shingle_classes_odd_rows(spark):
    t = " ".join(f"x{i}" for i in range(40))
    rows = [(3, t, 1), (3, t, 1), (None, t, 2), (9, t + " y", 3), (4, None, 4)]
    got = sorted(map(tuple, shingle_classes(spark.createDataFrame(rows, SCHEMA + ", owner int")).collect()), key=str)
    assert got == sorted([(3, 36, 3), (3, 36, 3), (None, 36, None), (9, 37, 3), (4, 0, 4)], key=str)
    assert shingle_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_links(x, cosine=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T >= cosine
    np.fill_diagonal(s, False)
    return s.sum(1), classes(len(x), list(zip(*np.nonzero(s), strict=True)))


@pytest.mark.parametrize("block", [16, 2048])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(vector_links, "BLOCK", block)
    monkeypatch.setattr(vector_links, "ASKS", 8 * block)
    r = np.random.default_rng(0)
    c = r.normal(size=(120, 24))
    hot = c[0] + 0.02 * r.normal(size=(60, 24))
    near = c + 0.09 * r.normal(size=c.shape)
    x = np.concatenate([c, hot, near])
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [float("inf")] * 24), (None, x[0].tolist()), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, []), (907, [None] * 24), (5, x[5].tolist())]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    got = [tuple(r) for r in linked_vectors(spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, home string")).collect()]
    assert len(got) == len(rows)
    n, want = brute_links(x)
    by = {g[0]: g[1:] for g in got}
    found = sum(by[i][0] for i in range(len(x)))
    assert found <= n.sum() and found >= 0.9 * n.sum()
    assert [by[i] for i in range(len(x))] == [(int(a), b, b == i) for i, (a, b) in enumerate(zip(n, want, strict=True))]
    assert [by[i][:2] for i in (900, 901, 902, 903, 904, 905, 906, 907, None)] == [(0, 900), (0, 901), (0, 902), (0, 903), (1, 904), (1, 904), (0, 906), (0, 907), (0, None)]
    assert linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vector_links_of_copies(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "BLOCK", 8)
    r = np.random.default_rng(3)
    x = np.concatenate([np.repeat(r.normal(size=(1, 6)), 40, 0), r.normal(size=(30, 6)), np.repeat(r.normal(size=(3, 6)), 5, 0)])
    x = np.concatenate([x, x[:1] + 1e-3, x[60:64] * 2])
    got = {r[0]: (r[1], r[2]) for r in linked_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    n, want = brute_links(x)
    assert [got[i] for i in range(len(x))] == [(int(a), b) for a, b in zip(n, want, strict=True)]


def test_two_levels_of_lists(monkeypatch):
    monkeypatch.setattr(vector_links, "FLAT", 8)
    r = np.random.default_rng(5)
    x = vector_links._unit(r.normal(size=(3000, 12)))
    q = vector_links.Quantiser(x, 40, 0.9)
    assert q.lists == 40
    middle = q.centroid(np.arange(40))
    far = ((x[:200, None] - middle) ** 2).sum(2)
    assert (q.nearest(x[:200], 3) == np.argsort(far, axis=1, kind="stable")[:, :3]).all()
    away = r.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    y = 0.905 * x + np.sqrt(1 - 0.905**2) * vector_links._unit(away)
    met = (q.nearest(y, q.probes) == q.nearest(x, 1)).any(1)
    assert met.mean() >= 0.98 and q.probes < 40


def test_recall_on_embeddings(spark):
    """Against brute force with the production sizes, also over pairs just above the threshold."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r[0], np.array(r[1], dtype=float)) for r in table.collect()]
    r = np.random.default_rng(8)
    ids, x = [i for i, _ in rows], np.stack([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    away = r.normal(size=unit.shape)
    away -= (away * unit).sum(1, keepdims=True) * unit
    near = 0.903 * unit + np.sqrt(1 - 0.903**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    every = np.concatenate([x, near])
    ids += [10**6 + i for i in range(len(near))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, every, strict=True)], "vec_id long, embedding array<double>")
    got = {r[0]: r[1] for r in linked_vectors(df).collect()}
    n = brute_links(every)[0]
    assert sum(got.values()) <= n.sum() and sum(got.values()) >= 0.99 * n.sum()
    assert all(got[i] <= k for i, k in zip(ids, n, strict=True))


def test_decontamination(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([6, 9, 18, 40])))) for i in range(12)] + [(90, None), (91, "a b")]
    docs, want = [], set()
    for d in range(120):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 150))]
        if d % 3 == 0:
            i = rnd.randrange(12)
            passage = items[i][1].split()
            for k in range(0, len(passage), 8):
                if len(passage) >= 18 and rnd.random() < 0.7:
                    passage[k] = "Zz"  # one token in eight substituted
            at = rnd.randrange(len(words) + 1)
            words[at:at] = passage
            want.add((d, i))
        docs.append((d, ", ".join(words).upper() if d % 2 else " ".join(words)))
    docs += [(None, items[2][1]), (200, None), (201, ""), (202, items[2][1]), (202, items[2][1])]
    want |= {(None, 2), (202, 2)}
    monkeypatch.setattr(decontamination, "BLOCK_SEEDS", 180)  # several blocks of benchmark items
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*d, 1) for d in docs], SCHEMA + ", p int")
    got = [(r["doc_id"], r["item_id"]) for r in contaminated(df, bench).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    assert contaminated(df.limit(0), bench).count() == 0
    assert contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_of_long_items_and_runs(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_SEEDS", 9_000)
    long = [f"n{i}" for i in range(5_000)]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, "a " * 300), (3, "la la la la la la la la la la b")], "item_id long, text string")
    docs = [(1, " ".join(long[4_000:4_016])), (2, " ".join(long[5:18])), (3, "a " * 500), (4, "x " + "la " * 30 + "b"), (5, "a " * 17 + "y"), (6, "a " * 9)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = {(r["doc_id"], r["item_id"]): (r["overlap"], r["matched"]) for r in contaminated(df, bench).collect()}
    assert got == {(1, 1): (16, 16), (3, 2): (20, 300), (4, 3): (11, 11), (5, 2): (17, 17)}


def test_masks_leave_a_seed():
    for width in range(1, 21):
        wrong = width - math.ceil(0.8 * width)
        for spoilt in combinations(range(width), wrong):
            assert any(not {at + p for p in m} & set(spoilt) for m in decontamination.masks(width, 0.8) for at in range(width - m[-1])), (width, spoilt)


def test_decontamination_at_the_threshold(spark):
    rnd = random.Random(9)
    items = {m: [f"w{rnd.randrange(60)}" for _ in range(m)] for m in (1, 3, 4, 5, 7, 9, 10, 12, 15, 16, 19, 20, 26)}
    docs = []
    for m, words in items.items():
        width = min(m, 20)
        spoilt = list(combinations(range(width), width // 5))
        for places in spoilt if len(spoilt) < 50 else rnd.sample(spoilt, 50):
            passage = [w if k not in places else "zz" for k, w in enumerate(words)][: width if rnd.random() < 0.5 else m]
            docs.append([f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(4))] + passage + [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(4))])
    want = set()
    for d, words in enumerate(docs):  # the item at every place of the document, without seeds
        for m, item in items.items():
            for at in range(1 - m, len(words)):
                e = [int(0 <= at + j < len(words) and words[at + j] == item[j]) for j in range(m)]
                if max(sum(e[j : j + 20]) for j in range(max(1, m - 19))) >= 0.8 * min(m, 20):
                    want.add((d, m))
    bench = spark.createDataFrame([(m, " ".join(w)) for m, w in items.items()], "item_id long, text string")
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], SCHEMA)
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(df, bench).collect()} == want
