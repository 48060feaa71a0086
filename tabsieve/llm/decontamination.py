"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Fixed masks pick some of a few consecutive tokens and ignore the others, so a substituted token spoils only the seeds
that look at it; masks are chosen by the length of an item so that no pattern within the threshold spoils all.
Seeds of documents meet seeds of benchmark items by hash; only the hashes, keys and places of seeds are broadcast.
Hits are reduced to distinct overlays of an item over a document, which then meet the item's tokens; equal tokens are
counted place by place.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masks (the places each looks at) by the least width that they serve.  Where a fifth of the width may be substituted,
#: every pattern leaves a place at which one of them sees equal tokens only: those of 5 in any width, as one of its
#: blocks of five has one substitution at most; those of 10 likewise by blocks of 10 and 15; those of 20 up to 24.
MASKS = {
    5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)),
    10: ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 2, 3, 4)),
    20: ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 8, 9), (0, 1, 2, 4, 5, 6)),
}
#: Seeds (about 60 bytes each) that are broadcast at a time; a larger benchmark is taken in blocks of places.
BLOCK_SEEDS = 600_000
#: Places of an item that go to a block together.
STRETCH = 1024
WINDOW, SHARE = 20, 0.8


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits (null: none)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def masks(width: int, share: float) -> tuple[tuple[int, ...], ...]:
    """Masks of which one at least hits wherever `share` of `width` places hold equal tokens."""
    wrong = width - math.ceil(share * width)
    if wrong > width // 5 or width < 5:
        return (tuple(range(max(1, width // (wrong + 1)))),)  # of wrong + 1 runs one is whole; the whole item if wrong is 0
    return MASKS[20 if 20 <= width < 25 else 10 if width >= 10 else 5]


def _seeded(rows: DataFrame, words: str, shapes: list[tuple[tuple[int, ...], Column]], keep: list[str], place: str) -> DataFrame:
    """keep, the place of every token and, for each shape (places, condition) that fits there, a hash h of what it sees.

    Places are exploded before anything is hashed: unlike higher-order functions, all of it is then generated code,
    and the words are carried by reference.  The outer variants keep the optimiser from deriving a filter on the
    number of words, which would split every text again.
    """
    n = F.size(words)
    rows = rows.select(*keep, F.posexplode_outer(words).alias("p", "word_"))
    p = F.col("p")
    hashes = [F.when(own & (p < n - places[-1]), F.xxhash64(F.lit(k), *[F.get(words, p + at) for at in places])) for k, (places, own) in enumerate(shapes)]
    return rows.select(*keep, p.alias(place), F.explode_outer(F.array(*hashes)).alias("h")).where("h is not null")


def _inside_run(words: str, place: str, span: int) -> Column:
    """Do the tokens from the one before this place to `span` after it all equal one another?

    Where that holds on both sides of a hit, the hit one place back on both sides is of the same overlay, so that runs
    of a and b equal tokens need a + b hits and not a * b.
    """
    p = F.col(place)
    # Written out by place, so that it is generated code and rows need not be copied for it.
    same = [F.coalesce(F.get(words, p + k) == F.get(words, p), F.lit(True)) for k in range(1, span + 1)]
    return reduce(Column.__and__, same, (p > 0) & F.coalesce(F.get(words, p - 1) == F.get(words, p), F.lit(False)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, window, overlap, matched, item_tokens): documents that hold benchmark text.

    A pair is returned if, with the item laid over the document at some hit, at least `share` of some `window`
    consecutive places (or of the whole item, if it is shorter) hold equal tokens; overlap is the most in such a
    window, matched the most over the whole item.  Only substitutions are tolerated within a window; an insertion
    begins another overlay.  Items under five tokens are found whole.  Null texts have no
    tokens; null ids are returned as null; repeated rows make one pair.  Items of any length go: their seeds are dealt
    to blocks by stretches, and an overlay meets only the words of the document that it covers.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("iw")).distinct()
    items = items.withColumn("m", F.size("iw")).where("m > 0").withColumn("g", F.xxhash64("iw"))
    width = F.least(F.col("m"), F.lit(window))
    total, widths = items.agg(F.sum("m"), F.collect_set(width)).first()
    served: dict[tuple[int, ...], list[int]] = {}
    for w in sorted(widths) or [window]:
        for places in masks(w, share):
            served.setdefault(places, []).append(w)
    most = max(sum(w in ws for ws in served.values()) for w in widths or [window])
    blocks = max(1, math.ceil((total or 0) * most / BLOCK_SEEDS))
    span = max(places[-1] for places in served)

    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("v"), tokens(F.col(text_col)).alias("w"))
    looked = _seeded(words, "w", [(places, F.lit(True)) for places in served], ["doc_id", "v", "w"], "p")
    seeds = _seeded(items, "iw", [(places, width.isin(ws)) for places, ws in served.items()], ["item_id", "iw", "m", "g"], "q")
    seeds = seeds.select("h", "item_id", "g", "m", "q", _inside_run("iw", "q", span).alias("run"))
    found = []
    for b in range(blocks):
        own = seeds.where(F.pmod(F.xxhash64("g", F.floor(F.col("q") / STRETCH)), F.lit(blocks)) == b)
        found.append(looked.join(F.broadcast(own), "h").where(~(F.col("run") & _inside_run("w", "p", span))))
    hits = reduce(DataFrame.unionByName, found)
    # Distinct overlays; a document's words travel once, and only if it has a hit.
    hits = hits.groupBy("doc_id", "v").agg(F.first("w").alias("w"), F.collect_set(F.struct("item_id", "g", "m", (F.col("p") - F.col("q")).alias("at"))).alias("hits"))
    hits = hits.select("doc_id", "w", F.explode("hits").alias("hit")).select("doc_id", "hit.*", "w")
    # The words under the item, and how many of its tokens stand before the document's first.
    over = F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, F.greatest(F.least(F.col("at") + F.col("m"), F.size("w")) - F.greatest(F.col("at"), F.lit(0)), F.lit(0)))
    hits = hits.select("doc_id", F.col("item_id").alias("own"), F.col("g").alias("own_g"), "m", F.greatest(-F.col("at"), F.lit(0)).alias("before"), over.alias("over"))
    hits = hits.join(items.select("item_id", "g", "iw"), F.col("own").eqNullSafe(F.col("item_id")) & (F.col("own_g") == F.col("g")))
    same = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.when((j >= F.col("before")) & (F.get("over", F.greatest(j - F.col("before"), F.lit(0))) == F.get("iw", j)), 1).otherwise(0))
    # explode_outer(array(...)) keeps the comparison out of the join's condition.
    hits = hits.select("doc_id", "item_id", "m", F.explode_outer(F.array(same)).alias("e")).withColumn("matched", F.aggregate("e", F.lit(0), lambda a, x: a + x))
    hits = hits.where(F.col("matched") >= F.lit(share) * width)
    # The greatest sum of a window, from a running one: one step for each token of the item.
    step = lambda s, j: s["now"] + F.get("e", j) - F.when(j >= width, F.get("e", F.greatest(j - width, F.lit(0)))).otherwise(0)
    best = F.aggregate(F.sequence(F.lit(0), F.col("m") - 1), F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), lambda s, j: F.struct(step(s, j).alias("now"), F.greatest(s["best"], step(s, j)).alias("best")), lambda s: s["best"])
    hits = hits.withColumn("window", width).withColumn("overlap", best).where(F.col("overlap") >= F.lit(share) * F.col("window"))
    return hits.groupBy("doc_id", "item_id").agg(F.max("window").alias("window"), F.max("overlap").alias("overlap"), F.max("matched").alias("matched"), F.max("m").alias("item_tokens"))


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """contaminated() over all documents and benchmark items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
