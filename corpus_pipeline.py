"""A corpus pipeline: quality, near-duplicates, repeated strings, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns the columns of
documents; the last returns packed pieces.  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.components import discard, saved, written
from tabsieve.llm.decontamination import contaminated
from tabsieve.llm.ngram_join import shingle_classes
from tabsieve.llm.packing import default_tokenizer, pack, pieces
from tabsieve.llm.quality import fit, score
from tabsieve.llm.repeated_strings import PASSAGE, remove_repeated_strings

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where(F.col("score_") >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id; rows without id stay."""
    dropped = shingle_classes(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def repeated_strings(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of PASSAGE bytes (fifty words) that occur elsewhere, each occurrence of them; those of which nothing is left go."""
    others = [c for c in docs.columns if c != "text"]
    out = remove_repeated_strings(docs, length=PASSAGE, carry=others, as_text=True).where("n_removed = 0 or kept <> ''")
    columns = [F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("carry_.n_chars")).cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col("kept").alias(c) if c == "text" else F.col(f"carry_.`{c}`") for c in docs.columns]
    return out.select(*columns)


def benchmark_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; rows without id are judged by their text."""
    key = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("i"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("t"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    keyed = docs.withColumn("key_", key)
    found = contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key_").select(F.col("doc_id").alias("key_")).distinct()
    return keyed.join(found, "key_", "left_anti").select(*docs.columns)


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in sequences of at most 2048 tokens."""
    return pack(saved(pieces(docs, default_tokenizer())))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packing),
]

#: No SQL: stages train a classifier and run a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what a stage no longer needs is deleted."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), set(written())
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        done = [w for w in written() if w not in kept]
        discard(spark, done[:-1])  # all but the table just written
    return STAGES[-1][1](spark, docs, sf_dir)
