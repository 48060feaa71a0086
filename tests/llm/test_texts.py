"""Licenses, quotes, archives, packing, the classifier and the pipeline."""

import hashlib
import os
import random
import re
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from tabsieve.llm import components, licenses, packing, quality, quotes, warc
from tabsieve.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_templates():
    a = [licenses.compile_template(k, v) for k, v in licenses.TEMPLATES.items()]
    for name, markup in licenses.TEMPLATES.items():
        for text in (re.sub("<<.*?>>", " x y ", markup.replace("<<optional>>", " ").replace("<<end>>", " ")), re.sub("<<optional>>.*?<<end>>|<<var.*?>>", " ", markup, flags=re.S)):
            found = licenses.scan_text(("Some words before. " + text + " and after").encode(), a)[2]
            assert name in {f[0] for f in found}, (name, text)
    text = licenses.TEMPLATES["isc-text"].replace("<<optional>>", "").replace("<<end>>", "").replace("fee", "payment")
    assert licenses.scan_text(text.encode(), a)[2] == []
    for bad in ("<<optional>> x", "a <<end>> b", "<<var 3>>"):
        with pytest.raises(ValueError):
            licenses.compile_template("bad", bad)


def test_license_scan(spark):
    rows = [(1, "The MIT  License, the Apache License; GNU General\nPublic-License"), (2, None), (3, ""), (4, "mit licenses"), (None, "çMIT License MIT license")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, base int")).collect()}
    assert [(b["label"], b["first"]) for b in got[1]["base"]] == [("mit", 1), ("apache", 4), ("gpl", 7)]
    assert got[1]["n_words"] == 10 and got[2]["n_words"] == got[3]["n_words"] == 0
    assert got[4]["base"] == [] and [b["first"] for b in got[None]["base"]] == [2]
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quotes(spark):
    rows = [(1, 0, "a", "Hello there\nhow are you?"), (1, 1, "b", "> Hello there\n> how are you?\nFine."), (1, 2, "a", ">> Hello there\n>> how are you?\n> Fine.\nGood"), (1, 3, "c", "> HELLO   there\nlate"), (1, 4, "b", None), (None, None, "b", "> x"), (1, 5, "a", "> > > nothing\n\nown"), (2, 0, "a", "> Hello there"), (2, 1, "a", "same"), (2, 1, "a", "same"), (2, 2, "b", "> same\nyes")]
    got = [r.asDict() for r in quotes.link_quotes(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, path int")).collect()]
    assert len(got) == len(rows)
    by = {(g["conv_id"], g["turn"]): g for g in got}
    assert [(by[1, t]["reply_to"], by[1, t]["depth"], by[1, t]["thread"], by[1, t]["text"]) for t in (1, 2, 3, 4, 5)] == [(0, 1, 0, "Fine."), (1, 2, 0, "Good"), (0, 1, 0, "late"), (None, 0, 4, ""), (None, 0, 5, "own")]
    assert by[2, 0]["reply_to"] is None and by[2, 2]["reply_to"] == 1
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_partial_quotes(spark):
    rows = [
        (0, "one line\ntwo lines\nthree lines\n\nsecond paragraph\nof two lines\n\nlast paragraph"),
        (1, "> two lines\n> three lines\nb"),  # two of three lines
        (2, "> second paragraph of\n> two lines\n>\n> last paragraph\nc"),  # two of three paragraphs, wrapped anew
        (3, "> one line\n> [...]\n> last paragraph\nd"),  # two lines out of more
        (4, "one line\nfour lines"),
        (5, "> one line\n> four lines\n> nowhere\ne"),  # a line that nobody wrote
        (6, "> four lines\n> one line\nf"),  # only the fourth holds both
        (7, "> e\n\n>> one line\n>> two lines\ng"),
    ]
    df = spark.createDataFrame([(1, t, "a", x) for t, x in rows], "conv_id long, turn int, role string, text string")
    got = {r["turn"]: (r["reply_to"], r["depth"], r["n_quoted"], r["n_linked"]) for r in quotes.link_quotes(df).collect()}
    assert got == {0: (None, 0, 0, 0), 1: (0, 1, 1, 1), 2: (0, 1, 1, 1), 3: (0, 1, 1, 1), 4: (None, 0, 0, 0), 5: (None, 0, 1, 0), 6: (4, 1, 1, 1), 7: (5, 1, 2, 2)}


def nested_links(rows):
    """Quotations by nested loops over the messages of each conversation."""
    said = {(c, t): quotes.parsed(x) for c, t, _, x in rows}
    reply, linked = {}, {}
    for (c, t), (_, _, quoted) in said.items():
        before = sorted(u for d, u in said if d == c and u < t)
        found = []
        for q in quoted:
            of = [u for u in before if q["piece"] in said[c, u][1]][:1]
            if not of:
                firsts = {next((u for u in before if p["piece"] in said[c, u][1]), None) for p in q["parts"]} - {None}
                held = {u: set().union(*(range(p["a"], p["b"] + 1) for p in q["parts"] if p["piece"] in said[c, u][1])) for u in firsts}
                of = sorted(u for u in firsts if len(held[u]) == q["n"])[:1]
            found += [(-q["level"], u) for u in of]
        reply[c, t], linked[c, t] = max(found)[1] if found else None, len(found)
    out = {}
    for c, t in said:
        root, depth = t, 0
        while reply[c, root] is not None:
            root, depth = reply[c, root], depth + 1
        out[c, t] = (reply[c, t], root, depth, len(said[c, t][2]), linked[c, t])
    return out


def test_quotes_match_nested_loops(spark):
    rnd = random.Random(12)
    rows = []
    for c in range(6):
        told = []
        for t in range(25):
            lines = [" ".join(rnd.choice("abcdefghij") * 3 for _ in range(rnd.randint(2, 5))) for _ in range(rnd.randint(1, 5))]
            if told and rnd.random() < 0.7:
                old = rnd.choice(told).split("\n")
                at = rnd.randrange(len(old))
                lines = ["> " + x for x in old[at : at + rnd.randint(1, 4)]] + rnd.choice([[], [""]]) + lines
            told.append("\n".join(lines))
            rows.append((c, t, "a", told[-1]))
    rows.append((9, 0, "a", "x " * 200_000))  # very long
    rows.append((9, 1, "b", "> " + "x " * 200_000 + "\nso"))
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["depth"], r["n_quoted"], r["n_linked"]) for r in got} == nested_links(rows)
    assert max(r["depth"] for r in got) > 3


def test_license_scan_of_long_texts():
    a = [licenses.compile_template(k, v) for k, v in licenses.TEMPLATES.items()]
    start = time.monotonic()
    n, base, found = licenses.scan_text(b"MIT license " * 200_000 + b"permission to use copy modify " * 50_000, a)
    assert n == 650_000 and len(base) == 200_000 and base[-1] == ("mit", 399_998, 400_000) and not found
    assert time.monotonic() - start < 30


def test_full_wording_is_needed():
    a = [licenses.compile_template(k, v) for k, v in licenses.TEMPLATES.items()]
    text = licenses.TEMPLATES["mit-text"].replace("<<optional>>", "").replace("<<end>>", "").replace("<<var 20>>", "Jane Roe or the holders")
    assert [f[0] for f in licenses.scan_text(text.encode(), a)[2]] == ["mit-permission", "mit-text"]
    assert [f[0] for f in licenses.scan_text(text.replace("TORT", "WORT").encode(), a)[2]] == ["mit-permission"]


def test_quote_levels():
    assert quotes.passages("a\n> b\n>> c\n> > d\ne") == [(0, "a"), (1, "b"), (2, "c\nd"), (0, "e")]


def test_warc_round_trip(spark, tmp_path):
    rnd = random.Random(5)
    long = ["".join(rnd.choice("abc <p>") for _ in range(rnd.randint(100, 3000))) for _ in range(20)]
    rows = [(i, f"http://x/{i}", rnd.choice(long)) for i in range(80)] + [(100, None, None), (101, "u\r\nv", "short"), (102, "w", "short"), (None, "n", long[0]), (103, "é", "")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    first: dict[str, int] = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(hashlib.sha256((h or "").encode()).hexdigest(), i)
    text = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        body = text[r["page_id"]]
        digest = hashlib.sha256(body).hexdigest()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), digest)
        again = len(body) >= 100 and first[digest] != r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[digest]) if again else ("response", None))
        assert r["payload"] == (None if again else body)
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_warc_errors():
    good = warc.record(1, "http://x", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2020-01-01T00:00:00Z")
    fields, block = warc.parse(good)
    assert warc.payload(fields, block) == (7, b"payload")
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"Date"), good + b"x"):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    with pytest.raises(warc.WarcError):
        warc.payload(*warc.parse(good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")))
    import zstandard

    d = warc.train([good] * 3)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d)).compress(good)
    archive = warc.dictionary_frame(d) + frame + warc.EMPTY_FRAME.encode() + frame
    assert list(warc.frames(archive)) == [good, good] and list(warc.frames(b"")) == []
    for bad in (archive[:-3], archive + b"\0" * 9, archive[:20]):
        with pytest.raises(warc.WarcError):
            list(warc.frames(bad))


def test_packing(spark):
    rnd = random.Random(6)
    words = ["the", "Quick", "brown,", "fox.", "don't", "naïve", "日本", "x1y2", "a-b"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 30, 400, 900, 5000])))) for i in range(60)] + [(70, None), (None, "the"), (3, "again"), (3, "again")]
    path = packing.default_tokenizer()
    got = packing.pack(packing.saved(packing.pieces(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int"), path))).toPandas()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in rows if i is not None and i != 3}
    for i, own in ids.items():
        p = got[got.doc_id == i].sort_values("start")
        assert p.start.tolist() == np.concatenate([[0], np.cumsum(p.length)[:-1]]).tolist() and p.length.sum() == len(own) and (p.doc_tokens == len(own)).all()
        assert p.ids_crc32.tolist() == [zlib.crc32(own[s : s + n].tobytes()) for s, n in zip(p.start, p.length, strict=True)]
    q = got.sort_values(["sequence_id", "offset"])
    assert (q.groupby("sequence_id").length.cumsum() - q.length == q.offset).all()
    assert q.groupby("sequence_id").length.sum().max() <= 2048 and got.sequence_id.nunique() == got.sequence_id.max() + 1
    assert len(got) == sum(-(-len(v) // 2048) for v in ids.values()) + 1 + (got.doc_id == 3).sum()
    empty = packing.pieces(spark.createDataFrame([], "doc_id long, text string"), path)
    assert packing.pack(empty).count() == 0


class _Step:
    """Stands for a DataFrame; gives the function that would run over its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, step, shape):
        return step


def test_packing_large_batches_in_little_memory(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(2_000)]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([0, 300, 900]))) for _ in range(3_000)] + [None, " ".join(words * 10)]
    path = packing.default_tokenizer()
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    packing.encode_words(" ".join(words).encode(), path)
    step = packing.pieces(_Step(), path)
    tracemalloc.start()
    got = [r for b in step(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 2 * 4_000_000 and peak < 100_000_000
    assert sorted({r["doc_id"] for r in got}) == list(range(len(texts)))
    for i in (0, 1, 1_500, 2_999, 3_000, 3_001):
        own = packing.encode_words((texts[i] or "").encode(), path) + np.array([1], "<u4").tobytes()
        parts = [r for r in got if r["doc_id"] == i]
        assert [r["ids_crc32"] for r in parts] == [zlib.crc32(own[k : k + 4 * 2048]) for k in range(0, len(own), 4 * 2048)]


def test_patterns():
    rnd = random.Random(7)
    for _ in range(40):
        hist = {rnd.randint(1, 64): rnd.randint(1, 50) for _ in range(rnd.randint(0, 20))}
        out = packing.patterns(hist, 64)
        used: dict[int, int] = {}
        for contents, count in out:
            assert count > 0 and sum(n * k for n, k in contents) <= 64
            for n, k in contents:
                used[n] = used.get(n, 0) + k * count
        assert used == hist and len(out) <= 2 * len(hist) + 1


def test_encoding_by_words():
    path = packing.default_tokenizer()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rnd = random.Random(8)
    for _ in range(300):
        t = "".join(rnd.choice(["a", "B", "é", "É", ".", ",", "'s", " ", "\n", "\t", "\x0b", "1", "ß", "İ", "Σ", "<|endoftext|>", " ", "-"]) for _ in range(rnd.randint(0, 25)))
        assert packing.encode_words(t.encode(), path) == np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def test_quality_held_out(spark):
    got = QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == got.doc_id.nunique() == 1000 and got.score.between(0, 1).all()
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = got[got.held_out].merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.9


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here", "a"), (None, None, "b"), (2, "", "c"), (2, "x" * 100_000, "d")], "doc_id long, text string, o string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == 4 and all(0 <= r["score_"] <= 1 for r in out)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_quality_fit_with_clashing_columns_and_ties(spark):
    rows = [(i, ["plain words of good text", "xx yy zz", "", None][i % 4], 1, 2, "t", 3) for i in range(60)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, o_ int, y_ int, text_ string, e int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 9, 9) for i in range(60)] * 2, "doc_id long, quality int, o_ int, e int")
    got = {}
    for r in quality.score(docs, quality.fit(docs, labels)).collect():
        got.setdefault(r["text"], set()).add(r["score_"])
    assert all(len(v) == 1 for v in got.values()) and got[""] == got[None]
    assert min(got["plain words of good text"]) > 0.5 > max(got["xx yy zz"])


def test_tables_are_discarded(spark):
    before = components.written()
    path = [w for w in (components.saved(spark.range(5)), components.written())[1] if w not in before]
    assert len(path) == 1 and spark.read.parquet(path[0]).count() == 5
    components.discard(spark, path)
    assert components.written() == before and not os.path.exists(path[0])


def test_long_words_are_told_apart():
    a = b"a" * 2048
    thue = bytes(b"ab"[bin(k).count("1") % 2] for k in range(4096))
    texts = [thue, thue.translate(bytes.maketrans(b"ab", b"ba")), a, a + b"a"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for ids, text in zip(packing.encode_texts(data, offsets, packing.default_tokenizer()), texts, strict=True):
        assert ids.tolist() == packing._tokenizer(packing.default_tokenizer()).encode(text.decode(), add_special_tokens=False).ids


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, text = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, SF))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    kept = docs.collect()
    for r in kept:
        assert r["n_chars"] == len(r["text"]) and (r["text"] == text[r["doc_id"]] or len(r["text"]) < len(text[r["doc_id"]]))
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in r["text"] for r in kept for b in bench)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept}
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = corpus_pipeline.saved(stage(spark, nothing, SF))
    assert nothing.count() == 0


def test_leaks_without_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(None, f"before {item} after"), (None, "nothing of it"), (None, None), (1, item), (2, "nor here")]
    left = corpus_pipeline.benchmark_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert left.columns == ["doc_id", "text"] and {tuple(r) for r in left.collect()} == {rows[1], rows[2], rows[4]}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    tidy = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert tidy(QUERIES[name](spark, SF).select(*columns).collect()) == tidy(want.fetchall())


def test_queries_and_sql_names():
    assert {re.match(r"op(\d+)_", q)[1] for q in QUERIES} == {str(i) for i in range(1, 11)}
    assert set(ORACLE_SQL) <= set(QUERIES)
