"""Connected components of a graph held as a DataFrame of edges, and tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Folders that this process has written and not discarded yet.
_WRITTEN: list[str] = []


def shared_dir(spark) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode, as in tests, a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or os.path.join(tempfile.gettempdir(), "tabsieve-checkpoints")


def new_folder(spark, name: str = "tabsieve") -> str:
    """A path in the shared folder that is not in use; discard() removes what is written there."""
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written() -> list[str]:
    """Folders that saved() and new_folder() have handed out and discard() has not removed."""
    return list(_WRITTEN)


def discard(spark, folders: list[str]) -> None:
    """Deletes folders whose tables are no longer needed."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _WRITTEN:
            _WRITTEN.remove(folder)


def saved(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again; survives lost executors."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of an undirected edge list (u, v) of longs.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes; a node with very many
    neighbours is a skewed join key, which adaptive execution splits.  Self-loops and nulls are dropped; an empty
    list gives an empty result.
    """
    e = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = _state(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = saved(small.where("u <> v").distinct())
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
