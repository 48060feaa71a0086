"""Queries of the library by operator number, each over whole tables, and their SQL written apart from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, binning, coverage, downstream, experiments, frames, generate, privacy, rules, statistics, validate
from ..sources import datasets, formats
from . import benchmark
from . import pairs as P

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def numbers(cols: list[str]) -> str:
    return "n AS (" + " UNION ALL ".join(f"SELECT '{s}' AS src, '{c}' AS col, {c}::DOUBLE AS v FROM {s} WHERE {c} IS NOT NULL" for s in "rs" for c in cols) + ")"


def labels(cols: list[str]) -> str:
    return "c AS (" + " UNION ALL ".join(f"SELECT '{s}' AS src, '{c}' AS col, {c} AS v FROM {s} WHERE {c} IS NOT NULL" for s in "rs" for c in cols) + ")"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})


# --- statistics -----------------------------------------------------------------------------------------------------

MOMENTS_SQL = """
m AS (SELECT col, src, count(*) AS k, avg(v) AS m, stddev_pop(v) AS sd FROM n GROUP BY col, src),
h AS (SELECT n.col, n.src, any_value(m.m) AS m, any_value(m.sd) AS sd, avg(pow(v - m.m, 3)) / pow(any_value(m.sd), 3) AS sk, avg(pow(v - m.m, 4)) / pow(any_value(m.sd), 4) AS ku
  FROM n JOIN m ON n.col = m.col AND n.src = m.src GROUP BY n.col, n.src),
e AS (SELECT a.col, least(abs(a.m - b.m) / greatest(a.sd, 1e-8), 1) AS e_mean, least(abs(a.sd - b.sd) / greatest(a.sd, 1e-8), 1) AS e_std,
  least(abs(a.sk - b.sk) / (abs(a.sk) + 0.5), 1) AS e_skew, least(abs(a.ku - b.ku) / (abs(a.ku) + 1), 1) AS e_kurt
  FROM h a JOIN h b ON a.col = b.col AND a.src = 'r' AND b.src = 's')
SELECT col, round(e_mean, 6) AS e_mean, round(e_std, 6) AS e_std, round(e_skew, 6) AS e_skew, round(e_kurt, 6) AS e_kurt,
  round(greatest(0, least(100, 100 * (1 - (0.40 * e_mean + 0.35 * e_std + 0.15 * e_skew + 0.10 * e_kurt)))), 2) AS score FROM e"""


@query("a01_moments", f"WITH {P.LI_SQL}, {numbers(P.LI_NUM)}, {MOMENTS_SQL}")
def a01(spark, sf):
    return rounded(statistics.moments(frames.stack(*P.lineitem(spark, sf), P.LI_NUM, []), P.LI_NUM), "e_mean", "e_std", "e_skew", "e_kurt")


@query("a01_moments_events", f"WITH {P.EV_SQL}, {numbers(P.EV_NUM)}, {MOMENTS_SQL}")
def a01e(spark, sf):
    return rounded(statistics.moments(frames.stack(*P.events(spark, sf), P.EV_NUM, []), P.EV_NUM), "e_mean", "e_std", "e_skew", "e_kurt")


KS_SQL = """
k AS (SELECT col, v, count(*) FILTER (src = 'r') AS a, count(*) FILTER (src = 's') AS b FROM n GROUP BY col, v),
w AS (SELECT col, sum(a) OVER (PARTITION BY col ORDER BY v) / sum(a) OVER (PARTITION BY col) AS fa, sum(b) OVER (PARTITION BY col ORDER BY v) / sum(b) OVER (PARTITION BY col) AS fb FROM k)
SELECT col, round(1 - max(abs(fa - fb)), 6) AS score FROM w GROUP BY col"""


@query("a02_ks", f"WITH {P.LI_SQL}, {numbers(P.LI_NUM)}, {KS_SQL}")
def a02(spark, sf):
    return rounded(statistics.kolmogorov(frames.stack(*P.lineitem(spark, sf), P.LI_NUM, []), P.LI_NUM), "score")


@query("a02_ks_events", f"WITH {P.EV_SQL}, {numbers(P.EV_NUM)}, {KS_SQL}")
def a02e(spark, sf):
    return rounded(statistics.kolmogorov(frames.stack(*P.events(spark, sf), P.EV_NUM, []), P.EV_NUM), "score")


TVD_SQL = """
k AS (SELECT col, v, count(*) FILTER (src = 'r') AS a, count(*) FILTER (src = 's') AS b FROM c GROUP BY col, v),
t AS (SELECT col, sum(a) AS ta, sum(b) AS tb FROM k GROUP BY col)
SELECT k.col, round(greatest(0, least(100, 100 * (1 - 0.5 * sum(abs(a / ta - b / tb))))), 2) AS score FROM k JOIN t ON k.col = t.col GROUP BY k.col"""


@query("a03_tvd", f"WITH {P.LI_SQL}, {labels(P.LI_CAT)}, {TVD_SQL}")
def a03(spark, sf):
    return statistics.total_variation(frames.stack(*P.lineitem(spark, sf), [], P.LI_CAT), P.LI_CAT)


@query("j01_tvd_customers", f"WITH {P.CU_SQL}, {labels(P.CU_CAT)}, {TVD_SQL}")
def j01(spark, sf):
    return statistics.total_variation(frames.stack(*P.customers(spark, sf), [], P.CU_CAT), P.CU_CAT)


def cramer(a: str, b: str) -> str:
    return f"""SELECT src, sum(o) AS n, sum(o * o / (ra * cb)) AS q, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM (
  SELECT src, a, b, o, sum(o) OVER (PARTITION BY src, a) AS ra, sum(o) OVER (PARTITION BY src, b) AS cb FROM (SELECT src, {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM u GROUP BY 1, 2, 3)) GROUP BY src"""


V_SQL = """sqrt(greatest(0, q - 1 - (k - 1) * (r - 1) / (n - 1)) / (least(r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)) - 1))"""
U_SQL = "u AS (SELECT 'r' AS src, * FROM r UNION ALL SELECT 's' AS src, * FROM s)"


@query("a04_cramers_v", f"WITH {P.PA_SQL}, {U_SQL}, g AS ({cramer('p_brand', 'p_type')}) SELECT src, round({V_SQL}, 6) AS v FROM g")
def a04(spark, sf):
    return rounded(statistics.cramers_v(frames.stack(*P.parts(spark, sf), [], P.PA_CAT), *P.PA_CAT), "v")


def eta(cat: str, num: str) -> str:
    return f"""SELECT src, sqrt(sum(k * pow(m - mm, 2)) / any_value(sst)) AS v FROM (SELECT src, {cat} AS a, count(*) AS k, avg({num}) AS m FROM u GROUP BY 1, 2) x
  JOIN (SELECT src, avg({num}) AS mm, var_pop({num}) * count(*) AS sst FROM u GROUP BY 1) y USING (src) GROUP BY src"""


@query("a05_correlation_ratio", f"WITH {P.EV_SQL}, {U_SQL}, g AS ({eta('event_type', 'value')}) SELECT src, round(v, 6) AS v FROM g")
def a05(spark, sf):
    return rounded(statistics.correlation_ratio(frames.stack(*P.events(spark, sf), ["value"], ["event_type"]), "event_type", "value"), "v")


def rho(a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY src ORDER BY {c}) + (count(*) OVER (PARTITION BY src, {c}) - 1) / 2.0"
    return f"SELECT src, corr(x, y) AS v FROM (SELECT src, {rank(a)} AS x, {rank(b)} AS y FROM u) GROUP BY src"


@query("a06_spearman", f"WITH {P.LI_SQL}, {U_SQL}, g AS ({rho('l_quantity', 'l_extendedprice')}) SELECT src, round(v, 6) AS v FROM g")
def a06(spark, sf):
    return rounded(statistics.spearman(frames.stack(*P.lineitem(spark, sf), P.LI_NUM, []), "l_quantity", "l_extendedprice"), "v")


_CU_ASSOC = " UNION ALL ".join([*[f"SELECT 'c_acctbal' AS i, '{c}' AS j, src, v FROM ({eta(c, 'c_acctbal')})" for c in P.CU_CAT], *[f"SELECT '{a}' AS i, '{b}' AS j, src, {V_SQL} AS v FROM ({cramer(a, b)})" for k, a in enumerate(P.CU_CAT) for b in P.CU_CAT[k + 1 :]]])


@query("a07_association_matrix", f"WITH {P.CU_SQL}, {U_SQL}, g AS ({_CU_ASSOC}) SELECT i, j, src, round(v, 6) AS v FROM g")
def a07(spark, sf):
    return rounded(statistics.associations(frames.stack(*P.customers(spark, sf), P.CU_NUM, P.CU_CAT), P.CU_NUM, P.CU_CAT), "v")


@query("a08_correlation_distance", f"WITH {P.CU_SQL}, {U_SQL}, g AS ({_CU_ASSOC}), p AS (SELECT i, j, max(v) FILTER (src = 'r') AS a, max(v) FILTER (src = 's') AS b FROM g GROUP BY i, j) SELECT round(greatest(0, 1 - sqrt(2 * sum(pow(a - b, 2))) / (2 * sqrt(12))) * 100, 2) AS score FROM p")
def a08(spark, sf):
    return statistics.correlation_distance(frames.stack(*P.customers(spark, sf), P.CU_NUM, P.CU_CAT), P.CU_NUM, P.CU_CAT)


TAIL_SQL = """q AS (SELECT col, src, (quantile_cont(v, 0.99) - quantile_cont(v, 0.5)) / greatest(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 1e-9) AS t FROM n GROUP BY col, src)
SELECT a.col, round(greatest(0, 100 - abs(a.t - b.t) / greatest(abs(a.t), 1e-9) * 100), 4) AS score FROM q a JOIN q b ON a.col = b.col AND a.src = 'r' AND b.src = 's'"""


@query("a10_tails", f"WITH {P.EV_SQL}, {numbers(P.EV_NUM)}, {TAIL_SQL}")
def a10(spark, sf):
    return rounded(statistics.tails(frames.stack(*P.events(spark, sf), P.EV_NUM, []), P.EV_NUM), "score", digits=4)


CONC_SQL = """o AS (SELECT col, src, abs(v) AS x, row_number() OVER (PARTITION BY col, src ORDER BY abs(v) DESC) AS rn, count(*) OVER (PARTITION BY col, src) AS k FROM n),
q AS (SELECT col, src, sum(x) FILTER (rn <= greatest(1, floor(0.05 * k))) / sum(x) AS t FROM o GROUP BY col, src)
SELECT a.col, round(a.t, 6) AS r, round(b.t, 6) AS s, round(greatest(0, 100 - abs(a.t - b.t) / greatest(abs(a.t), 1e-9) * 100), 4) AS score FROM q a JOIN q b ON a.col = b.col AND a.src = 'r' AND b.src = 's'"""


@query("a11_concentration", f"WITH {P.EV_SQL}, {numbers(P.EV_NUM)}, {CONC_SQL}")
def a11(spark, sf):
    return rounded(rounded(statistics.concentration(frames.stack(*P.events(spark, sf), P.EV_NUM, []), P.EV_NUM), "r", "s"), "score", digits=4)


_LI_RHO = " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, src, v FROM ({rho(a, b)})" for k, a in enumerate(P.LI_NUM) for b in P.LI_NUM[k + 1 :])


@query("a12_predictive_parity", f"""WITH {P.LI_SQL}, {U_SQL}, g AS ({_LI_RHO}), p AS (SELECT i, j, max(v) FILTER (src = 'r') AS a, max(v) FILTER (src = 's') AS b FROM g GROUP BY i, j),
k AS (SELECT rank() OVER (ORDER BY a) AS x, rank() OVER (ORDER BY b) AS y FROM p) SELECT round(greatest(0, corr(x, y) * 100), 4) AS parity FROM k""")
def a12(spark, sf):
    return rounded(statistics.predictive_parity(frames.stack(*P.lineitem(spark, sf), P.LI_NUM, []), P.LI_NUM), "parity", digits=4)


@query("a13_stylised_facts", f"""WITH {P.EV_SQL}, {numbers(P.EV_NUM)}, x AS ({TAIL_SQL.replace('q AS', 'WITH q AS', 1)}), y AS ({CONC_SQL.replace('o AS', 'WITH o AS', 1)}) SELECT round(avg(score), 3) AS score FROM (SELECT score FROM x UNION ALL SELECT score FROM y)""")
def a13(spark, sf):
    st = frames.stack(*P.events(spark, sf), P.EV_NUM, [])
    both = statistics.tails(st, P.EV_NUM).select("score").unionByName(statistics.concentration(st, P.EV_NUM).select("score"))
    return rounded(both.agg(F.avg(F.round("score", 4)).alias("score")), "score", digits=3)


@query("a18_group_summary", "SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS sem FROM lineitem GROUP BY 1, 2")
def a18(spark, sf):
    return rounded(experiments.group_summary(P.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"), "mean", "std", "sem")


@query("a19_conditional_counts", "SELECT event_type, count(*) FILTER (value > 50 AND user_id % 2 = 0) AS n_hit, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a19(spark, sf):
    return rounded(P.table(spark, sf, "events").groupBy("event_type").agg(F.count_if((F.col("value") > 50) & (F.col("user_id") % 2 == 0)).alias("n_hit"), F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query("a20_auc", """WITH k AS (SELECT round(value, 1) AS v, event_type = 'purchase' AS p FROM events), x AS (SELECT p, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM k)
SELECT round((sum(rk) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (count(*) FILTER (p) * count(*) FILTER (NOT p)::DOUBLE), 6) AS auc FROM x""")
def a20(spark, sf):
    e = P.table(spark, sf, "events").select(F.round("value", 1).alias("v"), (F.col("event_type") == "purchase").alias("p"))
    return rounded(statistics.auc(e, "v", "p"), "auc")


@query("a21_mode_median_distinct", "SELECT count(DISTINCT p_brand) AS n_brand, (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_type, round(quantile_cont(p_retailprice, 0.5), 6) AS median_price FROM part")
def a21(spark, sf):
    return rounded(P.table(spark, sf, "part").agg(F.count_distinct("p_brand").alias("n_brand"), F.mode(F.col("p_type"), True).alias("mode_type"), F.percentile("p_retailprice", 0.5).alias("median_price")), "median_price")


# --- bins, codes, projections, fills --------------------------------------------------------------------------------


@query("b01_bin_edges", f"WITH {P.LI_SQL}, d AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM r) SELECT (unnest(range(len(e))))::INTEGER AS k, round(unnest(e), 6) AS edge FROM d")
def b01(spark, sf):
    real, _ = P.lineitem(spark, sf)
    e = binning.bin_edges(real, ["l_extendedprice"])["l_extendedprice"]
    return rounded(spark.createDataFrame(list(enumerate(e)), "k int, edge double"), "edge")


@query("b02_binned_counts", f"""WITH {P.LI_SQL}, e AS (SELECT unnest(list_sort(list_distinct(quantile_cont(l_extendedprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])))) AS x FROM r),
i AS (SELECT list(x ORDER BY x)[2:-2] AS b FROM e) SELECT 'bin_' || len(list_filter(b, lambda y: s.l_extendedprice >= y)) AS label, count(*) AS n FROM s, i GROUP BY 1""")
def b02(spark, sf):
    real, syn = P.lineitem(spark, sf)
    e = binning.bin_edges(real, ["l_extendedprice"])
    return binning.apply_bins(syn, ["l_extendedprice"], e).groupBy(F.col("l_extendedprice").alias("label")).agg(F.count("*").alias("n"))


@query("b03_canonical_codes", "WITH w AS (SELECT max(length(c_custkey::VARCHAR)) AS k FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, lpad(c_custkey::VARCHAR, greatest(k, length(c_custkey::VARCHAR))::INTEGER, '0') AS code FROM customer, w WHERE c_custkey % 2 = 1")
def b03(spark, sf):
    c = P.table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("code"))
    return binning.canonical_codes(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), ["code"])[1]


@query("b04_interval_labels", "WITH q AS (SELECT quantile_cont(p_retailprice, [0, .25, .5, .75, 1]) AS e FROM part) SELECT CASE WHEN p_retailprice <= e[2] THEN 1 WHEN p_retailprice <= e[3] THEN 2 WHEN p_retailprice <= e[4] THEN 3 ELSE 4 END AS quarter, count(*) AS n FROM part, q GROUP BY 1")
def b04(spark, sf):
    p = P.table(spark, sf, "part")
    e = frames.quantiles(p, ["p_retailprice"], [0.0, 0.25, 0.5, 0.75, 1.0])["p_retailprice"]
    names = [f"({a}, {b}]" for a, b in zip(e[:-1], e[1:], strict=True)]
    place = F.array_position(F.array(*map(F.lit, names)), binning.interval_label("p_retailprice", e)).cast("int")
    return p.groupBy(place.alias("quarter")).agg(F.count("*").alias("n"))


@query("b06_encoder", f"""WITH {P.CU_SQL}, st AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM r), v AS (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS seg FROM r)
SELECT c_custkey, round((c_acctbal - m) / sd, 6) AS x0, (list_position(seg, c_mktsegment))::INTEGER AS hot FROM s, st, v""")
def b06(spark, sf):
    real, syn = P.customers(spark, sf)
    x = syn.select("c_custkey", binning.encoder(real, ["c_acctbal"], ["c_mktsegment"]).alias("x"))
    return rounded(x.select("c_custkey", F.col("x")[0].alias("x0"), F.array_position(F.slice("x", 2, 100), 1.0).cast("int").alias("hot")), "x0")


@query("b10_median_split", "SELECT l_orderkey, l_linenumber, (l_quantity > (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem))::INTEGER AS y FROM lineitem")
def b10(spark, sf):
    li = P.table(spark, sf, "lineitem")
    med = frames.quantile(li, "l_quantity", 0.5)
    return li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") > med).cast("int").alias("y"))


@query("p01_shared_projection", f"WITH {P.PA_SQL} SELECT p_brand, p_type, p_retailprice, p_size FROM s")
def p01(spark, sf):
    real, syn = P.parts(spark, sf)
    return syn.select(*frames.shared_columns(real.drop("p_partkey"), syn))


@query("p04_filters", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_type = 'ECONOMY' AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_size >= 10 AND p_size <= 40")
def p04(spark, sf):
    f, _ = frames.parse_filters(["p-type:ECONOMY", "p_brand:Brand#1,Brand#2,Brand#3", "p_size_min:10", "p_size_max:40"])
    return frames.where_filters(P.table(spark, sf, "part"), f)[0].select("p_partkey", "p_brand", "p_size")


@query("p07_drop_nulls", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events WHERE event_id % 7 <> 0")
def p07(spark, sf):
    return P.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value")).na.drop()


_HOLES = "h AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events)"


def _holes(spark, sf):
    return P.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))


for _how, _sql in {"dropna": "SELECT event_id, round(value, 6) AS value FROM h WHERE value IS NOT NULL", "mean": "SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM h)), 6) AS value FROM h", "median": "SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM h)), 6) AS value FROM h", "zero": "SELECT event_id, round(coalesce(value, 0), 6) AS value FROM h", "value": "SELECT event_id, round(coalesce(value, 7.5), 6) AS value FROM h", "forward": "SELECT event_id, round(coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY event_id), (SELECT arg_min(value, event_id) FROM h WHERE value IS NOT NULL)), 6) AS value FROM h"}.items():
    query(f"p09_fill_{_how}", f"WITH {_HOLES} {_sql}")(lambda spark, sf, how=_how: rounded(frames.fill(_holes(spark, sf), "value", how, 7.5, "event_id"), "value"))


@query("p10_zscore", "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS z FROM part")
def p10(spark, sf):
    return rounded(frames.standardise(P.table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("z")), ["z"]), "z")


@query("w15_strongest_pair", """WITH c AS (SELECT 'l_quantity,l_extendedprice' AS pair, abs(corr(l_quantity, l_extendedprice)) AS v FROM lineitem UNION ALL SELECT 'l_quantity,l_discount', abs(corr(l_quantity, l_discount)) FROM lineitem UNION ALL SELECT 'l_extendedprice,l_discount', abs(corr(l_extendedprice, l_discount)) FROM lineitem) SELECT arg_max(pair, v) AS pair FROM c""")
def w15(spark, sf):
    a, b = experiments.strongest_pair(P.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return spark.createDataFrame([(f"{a},{b}",)], "pair string")


# --- samples --------------------------------------------------------------------------------------------------------


@query("m01_sample", "SELECT c_custkey, c_acctbal FROM customer ORDER BY md5('42~' || c_custkey::VARCHAR), c_custkey LIMIT 100")
def m01(spark, sf):
    return frames.sample(P.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 100)


@query("m04_split", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42~' || o_orderkey::VARCHAR), o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.8) THEN 'train' ELSE 'test' END AS part_ FROM orders")
def m04(spark, sf):
    return frames.split_rows(P.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.8)


@query("m05_folds", "SELECT c_custkey, c_mktsegment, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42~' || c_custkey::VARCHAR), c_custkey) - 1) % 5)::INTEGER AS fold_ FROM customer")
def m05(spark, sf):
    return frames.folds(P.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 5)


@query("w12_difference", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def w12(spark, sf):
    o = P.table(spark, sf, "orders").select("o_orderkey")
    return experiments.unfinished(o, o.where("o_orderkey % 3 = 0"), ["o_orderkey"])


# --- integrity ------------------------------------------------------------------------------------------------------

_PARTS = "(l_linenumber % 5) / 4.0 AS a, (l_orderkey % 7) / 6.0 AS b, CASE WHEN l_orderkey % 11 = 0 THEN 1.0 ELSE 0.0 END AS c"
_V = {k: f"least(greatest(1 - {k}, 1e-4), 1)" for k in "abc"}


def _fuse(mode: str, how: str):
    def run(spark, sf):
        li = P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_linenumber") % 5) / 4.0).alias("a"), ((F.col("l_orderkey") % 7) / 6.0).alias("b"), F.when(F.col("l_orderkey") % 11 == 0, 1.0).otherwise(0.0).alias("c"))
        p = audit.fuse(F.col("a"), F.col("b"), F.col("c"), mode, how)
        return rounded(li.select("l_orderkey", "l_linenumber", p.alias("penalty")), "penalty").withColumn("flagged", F.col("penalty") > 0.5)

    return run


for _mode, _parts in {"full": "abc", "lse_only": "a", "nic_only": "b", "rules_only": "c", "lse_nic": "ab"}.items():
    for _how in ("geometric", "arithmetic"):
        _terms = [_V[k] for k in _parts]
        _mean = f"exp(({' + '.join(f'ln({t})' for t in _terms)}) / {len(_terms)})" if _how == "geometric" else f"({' + '.join(_terms)}) / {len(_terms)}"
        query(f"h04_fuse_{_mode}_{_how}", f"WITH x AS (SELECT l_orderkey, l_linenumber, {_PARTS} FROM lineitem), y AS (SELECT l_orderkey, l_linenumber, round(1 - {_mean}, 6) + 0.0 AS penalty FROM x) SELECT *, penalty > 0.5 AS flagged FROM y")(_fuse(_mode, _how))

_NAMES = ["n_name", "r_name", "c_mktsegment"]
_SETS = " UNION ALL ".join(f"SELECT [{', '.join(f'{chr(39)}{c}={chr(39)} || {c}' for c in s)}] AS items, count(*) AS n FROM r GROUP BY {', '.join(s)} HAVING count(*) >= (SELECT greatest(1, ceil(0.005 * count(*))) FROM r)" for s in (["c_mktsegment"], ["n_name"], ["r_name"], ["c_mktsegment", "n_name"], ["c_mktsegment", "r_name"], ["n_name", "r_name"], ["c_mktsegment", "n_name", "r_name"]))
RULES_SQL = f"""f AS ({_SETS}), t AS (SELECT count(*) AS total FROM r),
x AS (SELECT items, n, unnest(range(1, len(items) + 1)) AS k FROM f WHERE len(items) > 1),
y AS (SELECT items[k] AS head, list_filter(items, lambda v, i: i <> k) AS body, n FROM x),
z AS (SELECT y.head, array_to_string(y.body, ' AND ') AS antecedent_repr, y.n, b.n AS bn, y.n / b.n AS conf, (y.n / b.n) / (h.n / total) AS lift, total FROM y JOIN f b ON b.items = y.body JOIN f h ON h.items = [y.head], t),
rules AS (SELECT antecedent_repr, split_part(head, '=', 1) AS consequent_feature, split_part(head, '=', 2) AS consequent_value, round(n / total, 4) AS support, round(conf, 4) AS confidence, round(lift, 4) AS lift, n AS support_count, bn AS antecedent_count
  FROM z WHERE conf >= 0.95 AND lift >= 1 ORDER BY 5 DESC, 6 DESC, 4 DESC, 1 DESC, 2 DESC, 3 DESC LIMIT 25)"""


@query("h05_rules", f"WITH {P.CU_SQL}, {RULES_SQL} SELECT antecedent_repr, consequent_feature, consequent_value, support, confidence, lift, support_count, antecedent_count FROM rules")
def h05(spark, sf):
    return rules.mine_rules(P.customers(spark, sf)[0], _NAMES).drop("antecedents")


_BREAK = """k AS (SELECT row_number() OVER (ORDER BY confidence DESC, lift DESC, support DESC, antecedent_repr DESC, consequent_feature DESC, consequent_value DESC) - 1 AS rank, * FROM rules),
i AS (SELECT c_custkey, n_name, r_name, c_mktsegment, ['n_name=' || n_name, 'r_name=' || r_name, 'c_mktsegment=' || c_mktsegment] AS items FROM s),
b AS (SELECT c_custkey, rank, k.antecedent_repr, k.consequent_feature, k.consequent_value, items FROM i, k WHERE list_has_all(items, string_split(antecedent_repr, ' AND ')) AND NOT list_contains(items, consequent_feature || '=' || consequent_value))"""


def _mined(spark, sf):
    real, syn = P.customers(spark, sf)
    return syn, rules.mine_rules(real, _NAMES).collect()  # 25 rules at most


@query("h06_violations", f"WITH {P.CU_SQL}, {RULES_SQL}, {_BREAK} SELECT round((SELECT count(DISTINCT c_custkey) FROM b) / (SELECT count(*) FROM s), 4) AS rule_violation_rate, (SELECT count(*) FROM b) AS total_rule_hits, (SELECT count(*) FROM rules) AS num_rules_mined, (SELECT count(DISTINCT c_custkey) FROM b) AS num_rows_with_violations, (SELECT count(*) FROM s) AS rows_evaluated")
def h06(spark, sf):
    return rules.violation_summary(*_mined(spark, sf))


@query("w05_top_rules", f"WITH {P.CU_SQL}, {RULES_SQL}, {_BREAK} SELECT rank::INTEGER AS rule_rank, antecedent_repr, consequent_feature, consequent_value, count(*) AS violation_count FROM b GROUP BY ALL ORDER BY violation_count DESC, rule_rank LIMIT 10")
def w05(spark, sf):
    return rules.top_violated(*_mined(spark, sf)).select("rule_rank", "antecedent_repr", "consequent_feature", "consequent_value", "violation_count")


@query("w06_examples", f"""WITH {P.CU_SQL}, {RULES_SQL}, {_BREAK}, n AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY c_custkey) AS rn FROM b)
SELECT c_custkey::VARCHAR AS row_index, antecedent_repr AS antecedent, consequent_feature || '=' || consequent_value AS expected, list_filter(items, lambda v: starts_with(v, consequent_feature || '='))[1] AS actual FROM n WHERE rn <= 3 ORDER BY rank, c_custkey LIMIT 20""")
def w06(spark, sf):
    syn, found = _mined(spark, sf)
    return rules.violation_examples(syn, found, "c_custkey")


@query("h01_integrity_audit")
def h01(spark, sf):
    real, syn = P.customers(spark, sf)
    cols = [*P.CU_NUM, *P.CU_CAT]
    return audit.Auditor().fit(real.select(*cols), cols).score(syn)


_HUB_PAIRS = " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {x} AS u, {y} AS v, f FROM d" for y in P.CU_CAT for x in P.CU_CAT if x != y)


@query("h07_hub_scores", f"""WITH {P.CU_SQL}, k AS (SELECT *, md5(concat_ws('~', n_name, r_name, c_mktsegment)) AS k FROM r), d AS (SELECT *, (row_number() OVER (PARTITION BY substr(k, 1, 2) ORDER BY k) - 1) % 5 AS f FROM k),
e AS ({_HUB_PAIRS}), c AS (SELECT x, y, u, v, i AS f, count(*) FILTER (e.f <> i) AS rest, count(*) FILTER (e.f = i) AS hit FROM e, range(5) t(i) GROUP BY ALL HAVING count(*) FILTER (e.f <> i) > 0),
m AS (SELECT x, y, hit FROM c QUALIFY row_number() OVER (PARTITION BY x, y, u, f ORDER BY rest DESC, v DESC) = 1), a AS (SELECT x, y, sum(hit) / (SELECT count(*) FROM r) AS a FROM m GROUP BY 1, 2)
SELECT y AS hub, round(max(a), 6) AS score FROM a GROUP BY 1""")
def h07(spark, sf):
    real, _ = P.customers(spark, sf)
    a = audit.Auditor(audit.AuditConfig(mode="rules_only")).fit(real, P.CU_CAT)
    return rounded(spark.createDataFrame(a.hub_scores(real.select(*P.CU_CAT)), "hub string, score double"), "score")


_FLOORED = "greatest(0, least(1, (0.06 - p) / 0.06))"


@query("h09_sentinel_penalty", f"WITH x AS (SELECT l_orderkey, l_linenumber, l_discount AS p, l_tax AS q FROM lineitem) SELECT l_orderkey, l_linenumber, round({_FLOORED}, 6) AS penalty, round(1 - (1 - {_FLOORED}) * (1 - {_FLOORED.replace('0.06', '0.05').replace('- p', '- q')}), 6) AS both FROM x")
def h09(spark, sf):
    a, b = audit.sentinel_penalty(F.col("l_discount"), 0.06), audit.sentinel_penalty(F.col("l_tax"), 0.05)
    return rounded(P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", a.alias("penalty"), audit.combine([a, b]).alias("both")), "penalty", "both")


# --- privacy --------------------------------------------------------------------------------------------------------


@query("r02_exact_copies", "WITH a AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 1) SELECT count(*) AS n_exact, round(count(*) / (SELECT count(*) FROM documents WHERE doc_id % 2 = 1), 6) AS exact_rate, CASE WHEN count(*) = 0 THEN 'very_low' ELSE 'very_high' END AS risk FROM a")
def r02(spark, sf):
    d = P.table(spark, sf, "documents").select("doc_id", "text")
    return privacy.exact_copies(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["text"])


_LEVELS = lambda v, limits: f"CASE WHEN {v} < {limits[0]} THEN 'very_low' WHEN {v} < {limits[1]} THEN 'low' WHEN {v} < {limits[2]} THEN 'moderate' WHEN {v} < {limits[3]} THEN 'high' ELSE 'very_high' END"


def _draw(t: str, seed: int, n: int, key: str = "p_partkey") -> str:
    return f"(SELECT * FROM {t} ORDER BY md5('{seed}~' || {key}::VARCHAR), {key} LIMIT {n})"


_MEMBER_SQL = f"""WITH {P.PA_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY md5('42~' || p_partkey::VARCHAR), p_partkey) <= floor(0.8 * (SELECT count(*) FROM r)) AS tr FROM r),
t AS (SELECT p_partkey, p_retailprice, p_size FROM o WHERE tr), u AS (SELECT p_partkey, p_retailprice, p_size FROM o WHERE NOT tr),
a AS (SELECT * FROM {_draw('t', 43, 200)}), b AS (SELECT * FROM {_draw('u', 43, 200)}), d AS (SELECT * FROM {_draw('s', 43, 1000)}),
st AS (SELECT avg(p_retailprice) AS m1, stddev_pop(p_retailprice) AS s1, avg(p_size) AS m2, stddev_pop(p_size) AS s2 FROM (SELECT p_retailprice, p_size FROM a UNION ALL SELECT p_retailprice, p_size FROM b UNION ALL SELECT p_retailprice, p_size FROM d)),
q AS (SELECT 'm' || p_partkey AS qid, true AS member, (p_retailprice - m1) / s1 AS x, (p_size - m2) / s2 AS y FROM a, st UNION ALL SELECT 'h' || p_partkey, false, (p_retailprice - m1) / s1, (p_size - m2) / s2 FROM b, st),
e AS (SELECT (p_retailprice - m1) / s1 AS x, (p_size - m2) / s2 AS y FROM d, st),
n AS (SELECT qid, any_value(member) AS member, round(min(sqrt(pow(q.x - e.x, 2) + pow(q.y - e.y, 2))), 9) AS d FROM q, e GROUP BY qid)
"""


@query("r04_membership_inference", _MEMBER_SQL + "SELECT count(*) AS n, round(avg(d) FILTER (member), 6) AS member_d, round(avg(d) FILTER (NOT member), 6) AS other_d FROM n")
def r04(spark, sf):
    real, syn = P.parts(spark, sf)
    both = frames.split_rows(real, "p_partkey", 0.8)
    d = privacy.membership_distances(both.where("part_ = 'train'"), both.where("part_ = 'test'"), syn, ["p_retailprice", "p_size"], "p_partkey", 200, 43)
    return rounded(d.agg(F.count("*").alias("n"), F.avg(F.when(F.col("member"), F.round("d", 9))).alias("member_d"), F.avg(F.when(~F.col("member"), F.round("d", 9))).alias("other_d")), "member_d", "other_d")


@query("r04_membership_auc", _MEMBER_SQL + f"""SELECT round(auc, 4) AS auc, round(greatest(0, 2 * (round(auc, 4) - 0.5)), 4) AS advantage, {_LEVELS('round(auc, 4)', (0.52, 0.60, 0.70, 0.80))} AS risk FROM (
  SELECT (sum(rk) FILTER (member) - count(*) FILTER (member) * (count(*) FILTER (member) + 1) / 2.0) / (count(*) FILTER (member) * count(*) FILTER (NOT member)::DOUBLE) AS auc FROM (SELECT member, rank() OVER (ORDER BY -d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS rk FROM n))""")
def r04a(spark, sf):
    real, syn = P.parts(spark, sf)
    both = frames.split_rows(real, "p_partkey", 0.8)
    return privacy.membership_inference(both.where("part_ = 'train'"), both.where("part_ = 'test'"), syn, ["p_retailprice", "p_size"], "p_partkey", 200, 43)


_SUBSETS = [("n_name", "r_name"), ("n_name", "c_mktsegment"), ("r_name", "c_mktsegment"), ("n_name", "r_name", "c_mktsegment")]


@query("r05_singling_out", f"""WITH {P.CU_SQL}, a AS (SELECT *, ('0x' || substr(md5('s44~' || c_custkey::VARCHAR), 1, 8))::BIGINT % 4 AS k FROM {_draw('s', 44, 300, 'c_custkey')}),
h AS ({' UNION ALL '.join(f"SELECT a.c_custkey FROM a JOIN r ON a.k = {k} AND {' AND '.join(f'a.{c} = r.{c}' for c in s)} GROUP BY 1 HAVING count(*) = 1" for k, s in enumerate(_SUBSETS))})
SELECT (SELECT count(*) FROM a) AS n_attacks, count(*) AS n_singled, round(count(*) / (SELECT count(*) FROM a), 4) AS rate, {_LEVELS('round(count(*) / (SELECT count(*) FROM a), 4)', (0.001, 0.01, 0.05, 0.15))} AS risk FROM h""")
def r05(spark, sf):
    return privacy.singling_out(*P.customers(spark, sf), P.CU_CAT, "c_custkey")


@query("r06_linkability", f"""WITH {P.PA_SQL}, st AS (SELECT avg(p_retailprice) AS m1, stddev_pop(p_retailprice) AS s1, avg(p_size) AS m2, stddev_pop(p_size) AS s2 FROM r),
q AS (SELECT p_partkey, (p_retailprice - m1) / s1 AS x, (p_size - m2) / s2 AS y FROM {_draw('s', 45, 300)}, st), b AS (SELECT (p_retailprice - m1) / s1 AS x, (p_size - m2) / s2 AS y FROM r, st),
d AS (SELECT p_partkey, list_sort(list(sqrt(pow(q.x - b.x, 2) + pow(q.y - b.y, 2))))[1:2] AS d FROM q, b GROUP BY 1)
SELECT count(*) AS n_attacks, round(avg((d[2] > 0 AND d[1] / d[2] < 0.8)::INTEGER), 4) AS link_rate, round(round(avg((d[2] > 0 AND d[1] / d[2] < 0.8)::INTEGER), 4) / 0.5, 4) AS lift, {_LEVELS('round(avg((d[2] > 0 AND d[1] / d[2] < 0.8)::INTEGER), 4)', (0.52, 0.60, 0.70, 0.85))} AS risk FROM d""")
def r06(spark, sf):
    return privacy.linkability(*P.parts(spark, sf), ["p_retailprice", "p_size"], "p_partkey")


@query("r07_risk_levels", f"SELECT event_id, {_LEVELS('(event_id % 100) / 100.0', (0.52, 0.60, 0.70, 0.80))} AS auc_risk, {_LEVELS('(event_id % 100) / 500.0', (0.001, 0.01, 0.05, 0.15))} AS rate_risk, {_LEVELS('(event_id % 100) / 100.0', (0.52, 0.60, 0.70, 0.85))} AS link_risk FROM events")
def r07(spark, sf):
    x = F.col("event_id") % 100
    return P.table(spark, sf, "events").select("event_id", privacy.risk(x / 100, privacy.AUC_LIMITS).alias("auc_risk"), privacy.risk(x / 500, privacy.RATE_LIMITS).alias("rate_risk"), privacy.risk(x / 100, privacy.LINK_LIMITS).alias("link_risk"))


def _unit_of(key: str, label: str, seed: int = 42) -> str:
    return f"((('0x' || substr(md5('{label}{seed}~' || {key}::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def _laplace(value: str, key: str, scale: float) -> str:
    u = f"({_unit_of(key, 'l')} - 0.5)"
    return f"({value} - {scale} * sign({u}) * ln(1 - 2 * abs({u})))"


@query("r11_private_histogram", f"WITH n AS (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1), x AS (SELECT value, greatest(0, {_laplace('n', 'value', 1.0)}) AS x FROM n) SELECT value, round(x / sum(x) OVER (), 6) AS p FROM x")
def r11(spark, sf):
    return rounded(privacy.private_histogram(P.table(spark, sf, "events"), "event_type", 1.0), "p")


@query("r09_laplace_gaussian", f"SELECT p_partkey, round({_laplace('p_retailprice', 'p_partkey', 2.0)}, 5) AS laplace, round(p_retailprice + sqrt(-2 * ln({_unit_of('p_partkey', 'g')})) * cos(2 * pi() * {_unit_of('p_partkey', 'h')}) * sqrt(2 * ln(1.25 / 1e-5)) / 0.5, 5) AS gaussian FROM part")
def r09(spark, sf):
    key, price = F.col("p_partkey"), F.col("p_retailprice")
    return rounded(P.table(spark, sf, "part").select("p_partkey", privacy.laplace(price, 1.0, 0.5, key=key).alias("laplace"), privacy.gaussian(price, 1.0, 0.5, 1e-5, key=key).alias("gaussian")), "laplace", "gaussian", digits=5)


# --- validation -----------------------------------------------------------------------------------------------------


@query("v01_profile", " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, 0::BIGINT AS n_inf, count(*) AS n FROM part" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def v01(spark, sf):
    return validate.profile(P.table(spark, sf, "part"))


@query("v08_duplicates", "SELECT count(*) - count(DISTINCT text) AS n_duplicates FROM documents")
def v08(spark, sf):
    return validate.duplicates(P.table(spark, sf, "documents").select("text"))


@query("v09_infinite", "SELECT 'x' AS col, count(*) FILTER (event_id % 10 = 3) AS n_null, count(DISTINCT CASE WHEN event_id % 10 = 1 THEN 'Infinity'::DOUBLE WHEN event_id % 10 = 3 THEN NULL ELSE value END) AS n_distinct, count(*) FILTER (event_id % 10 = 1) AS n_inf, count(*) AS n FROM events")
def v09(spark, sf):
    return validate.profile(P.table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 1, float("inf")).when(F.col("event_id") % 10 == 3, float("nan")).otherwise(F.col("value")).alias("x")))


# --- generators -----------------------------------------------------------------------------------------------------


@query("g03_numeric_marginals", f"WITH {P.EV_SQL} SELECT 'value' AS col, 'lognormal' AS kind, round(avg(ln(value)), 6) AS loc, round(stddev_pop(ln(value)), 6) AS scale, round(min(value), 6) AS low, round(max(value), 6) AS high, round(quantile_cont(value, 0.5), 6) AS median FROM r UNION ALL SELECT 'user_id', 'normal', round(avg(user_id), 6), round(stddev_pop(user_id), 6), round(min(user_id), 6), round(max(user_id), 6), round(quantile_cont(user_id, 0.5), 6) FROM r")
def g03(spark, sf):
    return rounded(generate.numeric_marginals(P.events(spark, sf)[0], ["value", "user_id"]), "loc", "scale", "low", "high", "median")


@query("g04_categorical_marginal", "WITH n AS (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1), c AS (SELECT value, n / sum(n) OVER () AS p, sum(n) OVER (ORDER BY n DESC, value) / sum(n) OVER () AS cum FROM n) SELECT value, round(p, 6) AS p, round(cum, 6) AS cum, round(cum - p / 2, 6) AS mid FROM c")
def g04(spark, sf):
    return rounded(generate.categorical_marginal(P.table(spark, sf, "events"), "event_type"), "p", "cum", "mid")


def _copula(kind: str, filters: dict | None = None):
    def run(spark, sf):
        real, _ = P.events(spark, sf)
        return generate.make_generator(kind).fit(real.drop("event_id")).generate(1000, filters)

    return run


query("g06_gaussian_copula")(_copula("copula"))
query("g06_copula_filtered")(_copula("copula", {"event_type": "purchase", "value_min": 5.0}))
query("g09_vine_copula")(_copula("vine"))
query("g14_empirical_copula")(_copula("empirical"))

# --- coverage, downstream, detectors --------------------------------------------------------------------------------


_VEC = "(SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 2 = {})"


@query("j07_nearest", f"WITH d AS (SELECT q.vec_id AS id, b.vec_id AS base_id, list_distance(q.x, b.x) AS d FROM {_VEC.format(1)} q, {_VEC.format(0)} b), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 12), base_id) AS rank FROM d) SELECT id, base_id, round(d, 6) AS d, rank::INTEGER AS rank FROM k WHERE rank <= 2")
def j07(spark, sf):
    e = P.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return rounded(coverage.neighbours(e.where("id % 2 = 1"), e.where("id % 2 = 0"), 2), "d")


def _vectors(spark, sf):
    return P.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_retailprice"), F.col("p_size").cast("double")).alias("x"))


@query("x08_isolation_forest")
def x08i(spark, sf):
    return experiments.isolation_scores(_vectors(spark, sf))


@query("x09_mixture_density")
def x09(spark, sf):
    return experiments.mixture_density(_vectors(spark, sf))[1]


@query("a14_downstream")
def a14(spark, sf):
    return downstream.train_synthetic_test_real(*P.customers(spark, sf), "c_mktsegment", "c_custkey")


@query("a14_macro_f1", """WITH x AS (SELECT p_type AS y, CASE WHEN p_size % 3 = 0 THEN 'ECONOMY' ELSE p_type END AS p FROM part), k AS (SELECT DISTINCT y AS c FROM x UNION SELECT DISTINCT p FROM x),
n AS (SELECT c, (SELECT count(*) FROM x WHERE y = c AND p = c) AS tp, (SELECT count(*) FROM x WHERE y = c AND p <> c) AS fn, (SELECT count(*) FROM x WHERE y <> c AND p = c) AS fp FROM k) SELECT round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS f1 FROM n""")
def a14f(spark, sf):
    return rounded(downstream.macro_f1(P.table(spark, sf, "part").select(F.col("p_type").alias("y"), F.when(F.col("p_size") % 3 == 0, "ECONOMY").otherwise(F.col("p_type")).alias("p"))), "f1")


# --- experiments ----------------------------------------------------------------------------------------------------


def _chance(key: str, seed: int, label: str) -> str:
    return f"('0x' || substr(md5('{label}{seed}~' || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0"


@query("x01_permute", f"""WITH h AS (SELECT p_partkey, p_size FROM part WHERE {_chance('p_partkey', 42, 'p')} < 0.3), a AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('1042~' || p_partkey::VARCHAR), p_partkey) AS k FROM h),
b AS (SELECT p_size, row_number() OVER (ORDER BY md5('2042~' || p_partkey::VARCHAR), p_partkey) AS k FROM h) SELECT part.p_partkey, coalesce(b.p_size, part.p_size) AS p_size FROM part LEFT JOIN a ON a.p_partkey = part.p_partkey LEFT JOIN b ON a.k = b.k""")
def x01(spark, sf):
    return experiments.permute(P.table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey", ["p_size"], 0.3)


@query("x03_inject_cells", f"""WITH b AS (SELECT p_size AS z, row_number() OVER (ORDER BY md5('3042~' || p_partkey::VARCHAR), p_partkey) AS k FROM part) SELECT p.p_partkey, coalesce(b.z, p.p_size) AS p_size FROM part p LEFT JOIN b ON {_chance('p.p_partkey', 42, 'i')} < 0.2 AND b.k = floor({_chance('p.p_partkey', 42, 'j')} * (SELECT count(*) FROM part)) + 1""")
def x03(spark, sf):
    return experiments.inject_cells(P.table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey", ["p_size"], 0.2)


@query("x04_duplicate_rows", f"SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice FROM part UNION ALL SELECT p_partkey, round(p_retailprice + 0.01 * (SELECT stddev_pop(p_retailprice) FROM part) * (2 * ({_chance('p_partkey', 42, 'p_retailprice')}) - 1), 6) FROM part WHERE {_chance('p_partkey', 42, 'c')} < 0.1")
def x04(spark, sf):
    return rounded(experiments.duplicate_rows(P.table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_partkey", ["p_retailprice"], 0.1), "p_retailprice")


@query("x05_drop_features", f"SELECT p_partkey, CASE WHEN {_chance('p_partkey', 42, 'd')} < 0.25 AND md5('p_retailprice42~' || p_partkey::VARCHAR) < md5('p_type42~' || p_partkey::VARCHAR) THEN (SELECT quantile_cont(p_retailprice, 0.5) FROM part) ELSE p_retailprice END AS p_retailprice, CASE WHEN {_chance('p_partkey', 42, 'd')} < 0.25 AND md5('p_retailprice42~' || p_partkey::VARCHAR) > md5('p_type42~' || p_partkey::VARCHAR) THEN (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ELSE p_type END AS p_type FROM part")
def x05(spark, sf):
    return experiments.drop_features(P.table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_type"), "p_partkey", ["p_retailprice"], ["p_type"], 0.25)


@query("x06_covariate_shift", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= (SELECT quantile_cont(p_retailprice, 0.75) FROM part) ORDER BY md5('42~' || p_partkey::VARCHAR), p_partkey LIMIT 50")
def x06(spark, sf):
    return experiments.covariate_shift(P.table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", 50)


@query("x07_hallucinate", f"WITH v AS (SELECT list(DISTINCT p_type ORDER BY p_type) AS v FROM part) SELECT p_partkey, CASE WHEN {_chance('p_partkey', 42, 'h')} < 0.05 THEN v[(floor({_chance('p_partkey', 42, 'w')} * len(v)) + 1)::INTEGER] ELSE p_type END AS p_type FROM part, v")
def x07(spark, sf):
    return experiments.hallucinate(P.table(spark, sf, "part").select("p_partkey", "p_type"), "p_partkey", "p_type")


_DET = "d AS (SELECT event_id, round(value, 0) AS score, value > 60 AS flag, event_type = 'purchase' AS truth FROM events)"


def _detected(spark, sf):
    return P.table(spark, sf, "events").select("event_id", F.round("value", 0).alias("score"), (F.col("value") > 60).alias("flag"), (F.col("event_type") == "purchase").alias("truth"))


@query("x11_detection_metrics", f"""WITH {_DET}, k AS (SELECT score, count(*) FILTER (truth) AS p, count(*) AS n FROM d GROUP BY 1), c AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, coalesce(sum(n - p) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM k),
t AS (SELECT count(*) FILTER (flag AND truth) AS tp, count(*) FILTER (flag) AS f, count(*) FILTER (truth) AS p FROM d)
SELECT round(any_value(t.tp) / any_value(t.f), 6) AS precision, round(any_value(t.tp) / any_value(t.p), 6) AS recall, round(2 * any_value(t.tp) / (any_value(t.f) + any_value(t.p)), 6) AS f1, round(sum(c.p * (below + (n - c.p) / 2)) / (sum(c.p)::DOUBLE * sum(n - c.p)), 6) AS roc_auc, round(sum(c.p * cp / cn) / sum(c.p), 6) AS average_precision FROM c, t""")
def x11(spark, sf):
    return rounded(experiments.detection_metrics(_detected(spark, sf), "flag", "score", "truth"), "precision", "recall", "f1", "roc_auc", "average_precision")


@query("x12_matched_f1", f"WITH {_DET}, t AS (SELECT * FROM d ORDER BY score DESC, event_id DESC LIMIT (SELECT greatest(1, floor(count(*) * 0.1))::BIGINT FROM d)) SELECT round(2 * count(*) FILTER (truth) / (count(*) + (SELECT count(*) FILTER (truth) FROM d)), 6) AS f1 FROM t")
def x12(spark, sf):
    return rounded(experiments.matched_f1(_detected(spark, sf), "score", "truth", "event_id", 0.1), "f1")


_ID = "i AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_extendedprice * l_tax AS b, CASE WHEN l_orderkey % 7 = 0 THEN l_extendedprice * (1 + l_tax) * 1.05 ELSE l_extendedprice * (1 + l_tax) END AS t FROM lineitem)"


def _identity(spark, sf):
    x, tax = F.col("l_extendedprice"), F.col("l_tax")
    t = F.when(F.col("l_orderkey") % 7 == 0, x * (1 + tax) * 1.05).otherwise(x * (1 + tax))
    return P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", experiments.identity_error(x, x * tax, t).alias("error"))


@query("x13_identity_error", f"WITH {_ID} SELECT l_orderkey, l_linenumber, round(abs(a + b - t) / (abs(t) + 1e-9), 6) AS error FROM i")
def x13(spark, sf):
    return rounded(_identity(spark, sf), "error")


@query("x14_confirmation", f"WITH {_ID}, e AS (SELECT l_linenumber <= 3 AS flag, abs(a + b - t) / (abs(t) + 1e-9) AS error FROM i) SELECT flag, count(*) AS n, round(avg((error > 1e-3)::INTEGER), 6) AS rate, round(quantile_cont(error, 0.5) FILTER (error > 1e-3), 6) AS severity FROM e GROUP BY 1")
def x14(spark, sf):
    e = _identity(spark, sf).withColumn("flag", F.col("l_linenumber") <= 3)
    wrong = F.col("error") > 1e-3
    return rounded(e.groupBy("flag").agg(F.count("*").alias("n"), F.avg(wrong.cast("int")).alias("rate"), F.percentile(F.when(wrong, F.col("error")), 0.5).alias("severity")), "rate", "severity")


@query("x15_cell_bounds", "SELECT p_type AS hub, count(*) AS n, count(DISTINCT (p_brand, p_size)) AS support, round(pow(count(DISTINCT (p_brand, p_size)) / (count(*)::DOUBLE * count(*)), 0.25), 6) AS epsilon FROM part GROUP BY 1")
def x15(spark, sf):
    return rounded(experiments.cell_bounds(P.table(spark, sf, "part"), "p_type", ["p_brand", "p_size"]), "epsilon")


@query("x17_paired_t", "WITH d AS (SELECT avg(value) FILTER (event_id % 2 = 0) - avg(value) FILTER (event_id % 2 = 1) AS d FROM events GROUP BY event_type) SELECT round(avg(d), 6) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, round(avg(d) / stddev_samp(d), 6) AS d FROM d")
def x17(spark, sf):
    from ..functions.distributions import paired_t

    e = P.table(spark, sf, "events").groupBy("event_type").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b")).orderBy("event_type").collect()
    t = paired_t([r["a"] for r in e], [r["b"] for r in e])
    return rounded(spark.createDataFrame([(t["mean_diff"], t["t"], t["d"])], "mean_diff double, t double, d double"), "mean_diff", "t", "d")


@query("x19_representation_drift", "WITH g AS (SELECT c_mktsegment AS grp, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS f FROM customer GROUP BY 1) SELECT grp, n, round(f / n, 6) AS flag_rate, round(n / sum(n) OVER (), 6) AS share_before, round((n - f) / sum(n - f) OVER (), 6) AS share_after, round(100 * ((n - f) / sum(n - f) OVER () - n / sum(n) OVER ()), 6) AS shift_pp FROM g")
def x19(spark, sf):
    c = P.table(spark, sf, "customer").withColumn("flag", F.col("c_acctbal") < 0)
    return rounded(experiments.representation_drift(c, "c_mktsegment", "flag"), "flag_rate", "share_before", "share_after", "shift_pp")


@query("x23_threshold_sweep", "WITH t AS (SELECT unnest([0.1, 0.25, 0.5, 0.75])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER ((l_orderkey % 100) / 100.0 <= threshold) AS kept, round(avg(((l_orderkey % 100) / 100.0 <= threshold)::INTEGER), 6) AS rate FROM lineitem, t GROUP BY 1")
def x23(spark, sf):
    p = P.table(spark, sf, "lineitem").select(((F.col("l_orderkey") % 100) / 100.0).alias("p"))
    return rounded(experiments.threshold_sweep(p, "p", [0.1, 0.25, 0.5, 0.75]), "rate")


@query("x18_label_noise")
def x18(spark, sf):
    return benchmark.label_noise(P.customers(spark, sf)[0].select(*P.CU_CAT), "r_name")


_MODES_SQL = " UNION ALL ".join(f"SELECT '{m}' AS mode, 1 - pow({' * '.join(_V[k] for k in p)}, 1.0 / {len(p)}) AS p FROM x" for m, p in {"full": "abc", "lse_only": "a", "nic_only": "b", "rules_only": "c", "lse_nic": "ab"}.items())


@query("x25_ablation", f"WITH x AS (SELECT {_PARTS} FROM lineitem), y AS ({_MODES_SQL}) SELECT mode, round(1 - avg(p), 6) AS score, round(avg((round(p, 9) > 0.5)::INTEGER), 6) AS violation_rate FROM y GROUP BY 1")
def x25(spark, sf):
    li = P.table(spark, sf, "lineitem").select(((F.col("l_linenumber") % 5) / 4.0).alias("lse_"), ((F.col("l_orderkey") % 7) / 6.0).alias("nic_"), F.when(F.col("l_orderkey") % 11 == 0, 1.0).otherwise(0.0).alias("rule_"))
    return rounded(benchmark.ablation(li, True, 0.5 + 1e-9), "score", "violation_rate")


# --- sources --------------------------------------------------------------------------------------------------------


def _trip(fmt: str):
    def run(spark, sf):
        n = P.table(spark, sf, "nation")
        name = f"tabsieve-{uuid.uuid4().hex}"
        if fmt in ("csv", "parquet", "json"):  # in the folder that all executors share
            base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
            path = f"{base if '://' in base else 'file://' + base}/{name}"
        else:  # written and read whole on the driver
            path = f"{tempfile.gettempdir()}/{name}"
        return formats.read(spark, formats.write(n, path, fmt), fmt).select(*[F.col(c).cast(t).alias(c) for c, t in n.dtypes])

    return run


for _fmt in ("csv", "parquet", "arrow", "json", "stata"):
    query(f"s01_{_fmt}_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(_trip(_fmt))


@query("s25_clean_purchases", "SELECT c_custkey AS key, round(c_acctbal, 2) AS price, 'Unknown' AS note FROM customer")
def s25(spark, sf):
    c = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("Key"), F.concat(F.lit("$"), F.format_number("c_acctbal", 2)).alias("Price"), F.lit(None).cast("string").alias("Note"), F.lit("2020-01-01").alias("Order Date"))
    return rounded(datasets.clean_purchases(c), "price", digits=2)


from . import steps  # noqa: E402, F401  adds the queries of the smaller steps
