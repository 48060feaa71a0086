"""Pairs of real and synthetic tables over the test tables: odd rows, perturbed by fixed rules, stand for synthetic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LI_NUM, LI_CAT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]


def lineitem(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LI_NUM, *LI_CAT)
    real = li.where("l_orderkey % 2 = 0")
    syn = li.where("l_orderkey % 2 = 1").withColumn("l_extendedprice", F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice") * 1.1).otherwise(F.col("l_extendedprice")))
    syn = syn.withColumn("l_returnflag", F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") <= 2), "A").otherwise(F.col("l_returnflag")))
    return real, syn


CU_CAT, CU_NUM = ["n_name", "r_name", "c_mktsegment"], ["c_acctbal"]


def customers(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    # nation and region have 25 and 5 rows at every scale
    cu = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("c_custkey", *CU_CAT, *CU_NUM)
    syn = cu.where("c_custkey % 2 = 1").withColumn("r_name", F.when(F.col("c_custkey") % 10 == 1, "ASIA").otherwise(F.col("r_name")))
    return cu.where("c_custkey % 2 = 0"), syn


EV_NUM, EV_CAT = ["value", "user_id"], ["event_type"]


def events(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events").select("event_id", F.col("user_id").cast("double").alias("user_id"), "event_type", "value")
    syn = e.where("event_id % 2 = 1").withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value") * F.col("value") / 50).otherwise(F.col("value")))
    return e.where("event_id % 2 = 0"), syn


PA_CAT, PA_NUM = ["p_brand", "p_type"], ["p_retailprice", "p_size"]


def parts(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part").select("p_partkey", *PA_CAT, "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1")


# The same pairs in DuckDB SQL, written by hand; every query is a CTE list that ends in r and s.
LI_SQL = """li AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem),
r AS (SELECT * FROM li WHERE l_orderkey % 2 = 0),
s AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber = 1 THEN l_extendedprice * 1.1::DOUBLE ELSE l_extendedprice END AS l_extendedprice, l_discount, l_tax,
  CASE WHEN l_linestatus = 'O' AND l_linenumber <= 2 THEN 'A' ELSE l_returnflag END AS l_returnflag, l_linestatus FROM li WHERE l_orderkey % 2 = 1)"""
CU_SQL = """cu AS (SELECT c_custkey, n_name, r_name, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT * FROM cu WHERE c_custkey % 2 = 0),
s AS (SELECT c_custkey, n_name, CASE WHEN c_custkey % 10 = 1 THEN 'ASIA' ELSE r_name END AS r_name, c_mktsegment, c_acctbal FROM cu WHERE c_custkey % 2 = 1)"""
EV_SQL = """r AS (SELECT event_id, user_id::DOUBLE AS user_id, event_type, value FROM events WHERE event_id % 2 = 0),
s AS (SELECT event_id, user_id::DOUBLE AS user_id, event_type, CASE WHEN event_type = 'purchase' THEN value * value / 50 ELSE value END AS value FROM events WHERE event_id % 2 = 1)"""
PA_SQL = """r AS (SELECT p_partkey, p_brand, p_type, p_retailprice, p_size::DOUBLE AS p_size FROM part WHERE p_partkey % 2 = 0),
s AS (SELECT p_partkey, p_brand, p_type, p_retailprice, p_size::DOUBLE AS p_size FROM part WHERE p_partkey % 2 = 1)"""
