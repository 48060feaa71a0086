"""Chat formatting by quotation linking: replies are ordered by whom they quote, and quotes are taken out.

Quoted lines begin with one or more '>'.  Runs of lines of one quote level are passages; their normalised wording is
hashed and joined to the passages that messages of the same conversation wrote themselves.  A passage that nobody wrote
as a whole is looked for by its paragraphs, lines and pairs of neighbouring lines.  Threads are found by pointer
doubling; within a thread, turns are in the order of replies.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import saved

_BREAK = re.compile(r"\r\n|\r|\n")
_MARK = re.compile(r"[ \t]*((?:>[ \t]*)+)")


def normalised(text: str) -> str:
    """Lower case, white space collapsed, none at the ends."""
    return " ".join(text.lower().split())


def passages(text: str) -> list[tuple[int, str]]:
    """Runs of lines of one quote level: (level, wording without marks)."""
    out: list[tuple[int, list[str]]] = []
    for line in _BREAK.split(text):
        mark = _MARK.match(line)
        level = mark[1].count(">") if mark else 0
        body = line[mark.end() :] if mark else line
        if out and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
    return [(level, "\n".join(body)) for level, body in out]


def lines(text: str) -> list[str]:
    """Normalised lines that hold a letter or digit."""
    return [x for x in map(normalised, text.split("\n")) if any(map(str.isalnum, x))]


def pairs(of: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(of, of[1:])]


def parts(text: str) -> tuple[int, list[tuple[int, int, str]]]:
    """Number of lines; (first line, last line, wording) of every line, pair of neighbouring lines and paragraph."""
    every = lines(text)
    out = [(i, i, x) for i, x in enumerate(every)] + [(i, i + 1, x) for i, x in enumerate(pairs(every))]
    at = 0
    for p in re.split(r"\n\s*\n", text):
        n = len(lines(p))
        if n > 1:
            out.append((at, at + n - 1, normalised(p)))
        at += n
    return len(every), out


def parsed(text: str | None) -> tuple[str, list[str], list[dict]]:
    """A message without its quotes; what of it can be quoted (whole, by run, paragraph, line or two lines); what it quotes."""
    runs = passages(text or "")
    own = [body for level, body in runs if level == 0]
    clean = "\n".join(own).strip()
    pieces = {normalised(p) for p in [clean, *own, *re.split(r"\n\s*\n", clean), *clean.split("\n"), *pairs(lines(clean))]} - {""}
    quotes = []
    for level, body in runs:
        if level:
            n, of = parts(body)
            quotes.append({"level": level, "piece": normalised(body), "n": n, "parts": [{"a": a, "b": b, "piece": x} for a, b, x in of]})
    return clean, sorted(pieces), quotes


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotes), reply_to, thread, depth, n_quoted, n_linked.

    A message replies to the latest earlier message that it quotes at level 1 (or, where only deeper quotes are
    found, at the least level found); reply_to is that turn, or null.  The original of a passage is the first
    message of the conversation that wrote it itself.  If none wrote it as a whole, it is the first that holds all its
    lines (in paragraphs, pairs or alone; lines without letters and digits aside), among those that were the first to
    write one of these parts.  thread is the turn that its chain of replies begins with, depth the number of replies on
    the way from there: ordered by (conv_id, thread, turn), every reply follows what it answers.  n_quoted counts
    quoted passages, n_linked those whose original was found.  Null texts are empty, messages without conv_id or turn
    link with nothing (their thread is their own turn), and rows that share both are replies of one another's thread
    alike.  An empty table gives no rows.
    """
    m = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    m = m.withColumn("row_", F.xxhash64("conv_id", "turn", "role", "text"))
    part = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("piece", T.StringType())])
    quotes = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("piece", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("parts", T.ArrayType(part))]))
    shape = T.StructType([*m.schema.fields, T.StructField("clean", T.StringType()), T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("quotes", quotes)])

    of = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("piece", pa.string())]))

    def parse(batches):
        for b in batches:
            got = [parsed(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            listed = pa.array([g[2] for g in got], pa.list_(pa.struct([("level", pa.int32()), ("piece", pa.string()), ("n", pa.int32()), ("parts", of)])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string())), listed], names=[*b.schema.names, "clean", "pieces", "quotes"])

    runs = saved(m.mapInArrow(parse, shape))
    wrote = runs.select("conv_id", "turn", F.explode("pieces").alias("piece")).where("conv_id is not null and turn is not null")
    origin = wrote.groupBy("conv_id", F.xxhash64("piece").alias("h"), F.xxhash64(F.lit(1), "piece").alias("g")).agg(F.min("turn").alias("origin"))
    quoted = runs.select("conv_id", "turn", "row_", F.posexplode("quotes").alias("k", "q")).select("conv_id", "turn", "row_", "k", F.col("q.level").alias("level"), F.col("q.piece").alias("piece"), F.col("q.n").alias("n"), F.col("q.parts").alias("parts"))
    quoted = quoted.withColumn("h", F.xxhash64("piece")).withColumn("g", F.xxhash64(F.lit(1), "piece"))
    run = ["conv_id", "turn", "row_", "k"]
    met = saved(quoted.join(origin, ["conv_id", "h", "g"]).where("origin < turn").select(*run, "level", "origin"))
    # Of the other passages: first writers of any part, and how many lines each of them holds in all.
    rest = quoted.join(met, run, "left_anti").select(*run, "level", "n", F.explode("parts").alias("p")).select(*run, "level", "n", "p.a", "p.b", F.xxhash64("p.piece").alias("h"), F.xxhash64(F.lit(1), "p.piece").alias("g"))
    rest = saved(rest)
    if not rest.isEmpty():
        first = rest.join(origin, ["conv_id", "h", "g"]).where("origin < turn").select(*run, "origin").distinct()
        own = wrote.select("conv_id", F.col("turn").alias("origin"), F.xxhash64("piece").alias("h"), F.xxhash64(F.lit(1), "piece").alias("g"))
        held = rest.join(first, run).join(own, ["conv_id", "origin", "h", "g"], "left_semi")
        held = held.select(*run, "level", "n", "origin", F.explode(F.sequence("a", "b")).alias("i")).groupBy(*run, "level", "n", "origin").agg(F.countDistinct("i").alias("i")).where("i = n")
        met = met.unionByName(held.groupBy(*run, "level").agg(F.min("origin").alias("origin")))
    replies = met.groupBy("conv_id", "turn", "row_").agg(F.countDistinct("k").alias("n_linked"), F.max_by("origin", F.struct(-F.col("level"), F.col("origin"))).alias("reply_to"))

    # Threads by pointer doubling: each round, a message's furthest known ancestor becomes that one's own furthest.
    step = saved(replies.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up")).withColumn("depth", F.lit(1).cast("long")))
    while True:
        over = step.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        both = saved(step.join(over, ["conv_id", "up"], "left"))
        if both.where("up2 is not null").isEmpty():
            break
        step = both.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    base = runs.select("conv_id", "turn", "role", "row_", F.col("clean").alias("text"), F.size("quotes").cast("long").alias("n_quoted"))
    out = base.join(replies, ["conv_id", "turn", "row_"], "left").join(step.select("conv_id", "turn", "up", F.col("depth").alias("far")), ["conv_id", "turn"], "left")
    replied = F.col("reply_to").isNotNull()
    return out.select("conv_id", "turn", "role", "text", "reply_to", F.when(replied, F.col("up")).otherwise(F.col("turn")).alias("thread"), F.when(replied, F.col("far")).otherwise(F.lit(0)).cast("long").alias("depth"), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))


def op4_quotation_linking(spark, sf_dir: str) -> DataFrame:
    """link_quotes() over all conversations."""
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
