"""Queries of the smaller steps (names, filters, cleaning, checks, coverage), with SQL written apart from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import binning, coverage, downstream, experiments, frames, generate, privacy, rules, validate
from ..sources import datasets, formats
from . import benchmark
from . import pairs as P
from .catalogue import _BREAK, _NAMES, KS_SQL, MOMENTS_SQL, RULES_SQL, TVD_SQL, _chance, labels, numbers, query, rounded


def values(rows: list[tuple], names: str) -> str:
    """SQL of a few fixed rows."""
    quoted = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"{v}::DOUBLE" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({names})"


# --- sources --------------------------------------------------------------------------------------------------------

_FILES = ["a.csv", "b.PARQUET", "c.pq", "d.feather", "e.ipc", "f.json", "g.dta", "h.sas7bdat", "i.xlsx", "folder/plain", "k.csv.gz"]


@query("s15_infer_format", values(list(zip(_FILES, ["csv", "parquet", "parquet", "arrow", "arrow", "json", "stata", "sas", "excel", "csv", "csv"], strict=True)), "path, format"))
def s15(spark, sf):
    return spark.createDataFrame([(f, formats.infer_format(f)) for f in _FILES], "path string, format string")


_PATHS = ["/tmp/x.csv", "/tmp/a/../b.csv", "/etc/passwd", "/tmp/../etc/passwd"]


def _safe(path: str) -> bool:
    try:
        return bool(formats.check_safe_path(path))
    except ValueError:
        return False


@query("s16_safe_paths", values(list(zip(_PATHS, [True, True, False, False], strict=True)), "path, safe"))
def s16(spark, sf):
    return spark.createDataFrame([(p, _safe(p)) for p in _PATHS], "path string, safe boolean")


_CATALOGUE = [
    ("census_acs", "Census ACS Income & Housing", "Tax & Income", "US Census ACS 5-Year 2022"),
    ("adult", "Adult Census Income", "Tax & Income", "UCI Machine Learning Repository"),
    ("credit", "Credit Card Default", "Financial Services", "UCI Machine Learning Repository"),
    ("supermarket_sales", "Supermarket Sales", "Retail & E-commerce", "plotly datasets"),
    ("online_purchases", "Online Purchases", "Retail & E-commerce", "public purchase history"),
]


@query("s19_catalogue", values(_CATALOGUE, "id, name, vertical, source"))
def s19(spark, sf):
    return datasets.catalogue(spark)


@query("s17_datasets_of_vertical", values([(r[0], r[1]) for r in _CATALOGUE[3:]], "id, name"))
def s17(spark, sf):
    return spark.createDataFrame([(d["id"], d["name"]) for d in datasets.list_datasets("RETAIL & e-commerce")], "id string, name string")


_ACS = {"B19013_001E": "if(c_custkey % 17 = 0, 'x', cast(c_custkey * 10 as string))", "B25105_001E": "c_custkey % 900", "B25071_001E": "c_custkey % 50", "B17001_002E": "c_custkey % 7", "B17001_001E": "c_custkey % 11", "B23025_005E": "c_custkey % 3", "B23025_002E": "c_custkey % 13", "B25010_001E": "c_custkey % 5", "B25003_002E": "c_custkey % 4", "B25003_001E": "10", "B01002_001E": "c_custkey % 90", "B15003_022E": "c_custkey % 6", "B15003_001E": "20"}


@query("s21_clean_census", """SELECT (c_custkey % 100)::VARCHAR AS puma, c_mktsegment AS state, c_custkey * 10.0::DOUBLE AS household_income, (c_custkey % 900)::DOUBLE AS housing_cost, (c_custkey % 50)::DOUBLE AS cost_burden_pct,
  round((c_custkey % 7) / (c_custkey % 11)::DOUBLE, 6) AS poverty_status, round(1 - (c_custkey % 3) / (c_custkey % 13)::DOUBLE, 6) AS employment_status, (c_custkey % 5)::DOUBLE AS household_size, round((c_custkey % 4) / 10.0::DOUBLE, 6) AS tenure,
  (c_custkey % 90)::DOUBLE AS age_group, round((c_custkey % 6) / 20.0::DOUBLE, 6) AS education FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0""")
def s21(spark, sf):
    raw = P.table(spark, sf, "customer").selectExpr(*[f"cast({e} as string) AS {c}" for c, e in _ACS.items()], "cast(c_custkey % 100 as string) AS `public use microdata area`", "c_mktsegment AS state")
    return rounded(datasets.clean_census(raw), "poverty_status", "employment_status", "tenure", "education")


@query("s22_clean_adult", "SELECT c_custkey AS age, c_mktsegment AS workclass, 'Married' AS marital_status FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def s22(spark, sf):
    raw = P.table(spark, sf, "customer").selectExpr("c_custkey AS age", "if(c_custkey % 7 = 0, null, c_mktsegment) AS workclass", "if(c_custkey % 5 = 0, ' ?', ' Married ') AS `marital-status`", "1 AS fnlwgt", "2 AS `education-num`")
    return datasets.clean_adult(raw)


@query("s23_clean_credit", "SELECT (c_custkey % 2 + 1)::VARCHAR AS sex, (c_custkey % 4)::VARCHAR AS education, (c_custkey % 9 - 2)::VARCHAR AS pay_0, round(c_acctbal, 2) AS pay_amt1, (c_custkey % 2)::VARCHAR AS \"default\" FROM customer")
def s23(spark, sf):
    raw = P.table(spark, sf, "customer").selectExpr("c_custkey AS ID", "c_custkey % 2 + 1 AS SEX", "c_custkey % 4 AS EDUCATION", "c_custkey % 9 - 2 AS PAY_0", "c_acctbal AS PAY_AMT1", "c_custkey % 2 AS `default payment next month`")
    return rounded(datasets.clean_credit(raw), "pay_amt1", digits=2)


@query("s24_clean_supermarket", "SELECT round(c_acctbal, 2) AS unit_price, c_mktsegment AS product_line, (c_custkey % 20) AS tax_5pct, CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 10)::DOUBLE END AS rating FROM customer")
def s24(spark, sf):
    raw = P.table(spark, sf, "customer").selectExpr("c_custkey AS `Invoice ID`", "c_acctbal AS `Unit price`", "c_mktsegment AS `Product line`", "c_custkey % 20 AS `Tax 5%`", "if(c_custkey % 6 = 0, 'n/a', cast(c_custkey % 10 as string)) AS Rating", "'1/5/2019' AS Date", "'13:08' AS Time", "4.76 AS `gross margin percentage`")
    return rounded(datasets.clean_supermarket(raw), "unit_price", digits=2)


@query("s26_append_results", "SELECT n_nationkey, 2::BIGINT AS n FROM nation")
def s26(spark, sf):
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    path = f"{base if '://' in base else 'file://' + base}/tabsieve-{uuid.uuid4().hex}"
    for _ in range(2):
        formats.append_results(P.table(spark, sf, "nation"), path)
    return spark.read.parquet(path).groupBy("n_nationkey").agg(F.count("*").alias("n"))


# --- projections, filters, codes ------------------------------------------------------------------------------------

_ROLES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("p02_resolve_columns", values(list(enumerate(_ROLES)), "place, col"))
def p02(spark, sf):
    return spark.createDataFrame(list(enumerate(frames.resolve_columns(P.table(spark, sf, "lineitem"), {"numeric", "categorical"}))), "place int, col string")


@query("p03_conform", "SELECT event_id, CASE WHEN event_id % 9 < 2 THEN NULL ELSE event_id::DOUBLE END AS t, (event_id % 3)::VARCHAR AS g FROM events")
def p03(spark, sf):
    odd = F.when(F.col("event_id") % 9 == 0, "abc").when(F.col("event_id") % 9 == 1, "NaN").otherwise(F.col("event_id").cast("string"))
    return frames.conform(P.table(spark, sf, "events").select("event_id", odd.alias("t"), (F.col("event_id") % 3).alias("g")), ["t"], ["g"], ["event_id"])


_FILTERS = ["State-Code:CA", "income_min:10", "income_max:many", "kind:a, b", "nothing", "when: 10:30"]


@query("p05_parse_filters", values([("state_code", "CA", True), ("income_min", "10.0", True), ("kind", "a|b", True), ("when", "10:30", True), ("income_max:many", None, False), ("nothing", None, False)], "key, value, good"))
def p05(spark, sf):
    good, bad = frames.parse_filters(_FILTERS)
    rows = [(k, "|".join(v) if isinstance(v, list) else str(v), True) for k, v in good.items()] + [(b, None, False) for b in bad]
    return spark.createDataFrame(rows, "key string, value string, good boolean")


@query("p06_drop_existing", "SELECT n_nationkey, n_name FROM nation")
def p06(spark, sf):
    return frames.drop_existing(P.table(spark, sf, "nation"), ["N_REGIONKEY", "absent"])


@query("b10_codes", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS code_ FROM part")
def b10c(spark, sf):
    return frames.codes(P.table(spark, sf, "part").select("p_partkey", "p_type"), "p_type").select("p_partkey", "code_")


@query("b09_aligned_dummies", f"WITH {P.CU_SQL}, v AS ({' UNION '.join(f'SELECT {chr(39)}{c}{chr(39)} AS col, {c} AS value FROM r' for c in P.CU_CAT)}), n AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS col, {c} AS value, count(*) AS n FROM s GROUP BY 2' for c in P.CU_CAT)}) SELECT col, value, coalesce(n, 0)::DOUBLE AS total FROM v LEFT JOIN n USING (col, value)")
def b09(spark, sf):
    real, syn = P.customers(spark, sf)
    found = downstream.aligned_dummies(real, P.CU_CAT)
    row = syn.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for _, _, c in found]).first()
    return spark.createDataFrame([(col, value, total) for (col, value, _), total in zip(found, row, strict=True)], "col string, value string, total double")


@query("x21_rule_mask", f"WITH {P.CU_SQL}, {RULES_SQL}, {_BREAK} SELECT c_custkey, c_custkey IN (SELECT c_custkey FROM b) AS violates_ FROM s")
def x21(spark, sf):
    real, syn = P.customers(spark, sf)
    return rules.rule_mask(syn, real, _NAMES).select("c_custkey", "violates_")


# --- checks, marginals, budgets -------------------------------------------------------------------------------------


@query("v02_validate", """WITH n AS (SELECT count(*) AS n, count(DISTINCT c_name) AS names, count(*) - count(DISTINCT (c_nationkey, c_mktsegment)) AS extra FROM customer)
SELECT 'error' AS kind, 'missing required columns: [''c_phone'']' AS message UNION ALL SELECT 'error', 'column ''c_mktsegment'' is not numeric' UNION ALL SELECT 'warning', 'column ''c_nationkey'' is numeric, not categorical'
UNION ALL SELECT 'error', 'too few rows: ' || n || ' < 10000000' FROM n UNION ALL SELECT 'warning', 'column ''c_one'' is constant' UNION ALL SELECT 'error', 'column ''c_gone'' has 100.0% nulls' UNION ALL SELECT 'warning', 'column ''c_gone'' is all null'
UNION ALL SELECT 'warning', extra || ' duplicate rows (' || format('{:.1f}', extra / n * 100) || '%)' FROM n""")
def v02(spark, sf):
    c = P.table(spark, sf, "customer").selectExpr("c_nationkey", "c_mktsegment", "'x' AS c_one", "cast(null as string) AS c_gone")
    got = validate.validate(c, min_rows=10_000_000, required_columns=["c_phone"], expected_dtypes={"c_mktsegment": "numeric", "c_nationkey": "categorical"})
    return spark.createDataFrame([("error", e) for e in got.errors] + [("warning", w) for w in got.warnings], "kind string, message string")


@query("g01_marginal_kinds", "SELECT 'p_retailprice' AS col, CASE WHEN skewness(p_retailprice) > 1 AND min(p_retailprice) > 0 THEN 'lognormal' ELSE 'normal' END AS kind FROM part UNION ALL SELECT 'p_size', CASE WHEN skewness(p_size) > 1 AND min(p_size) > 0 THEN 'lognormal' ELSE 'normal' END FROM part UNION ALL SELECT 'p_type', 'categorical'")
def g01(spark, sf):
    g = generate.make_generator("copula").fit(P.table(spark, sf, "part").select("p_retailprice", "p_size", "p_type"))
    return spark.createDataFrame(sorted(g.marginal_kinds().items()), "col string, kind string")


@query("g05_correlation", "SELECT round(corr(p_retailprice, p_size), 4) AS r FROM part")
def g05(spark, sf):
    g = generate.make_generator("copula").fit(P.table(spark, sf, "part").select("p_retailprice", "p_size"))
    return rounded(spark.createDataFrame([(float(g.correlation_matrix().iloc[0, 1]),)], "r double"), "r", digits=4)


@query("r12_privacy_budget", values([("a", 0.4, True, 0.6), ("b", 0.5, True, 0.1), ("c", 0.2, False, 0.0)], "label, epsilon, granted, remaining"))
def r12(spark, sf):
    budget, rows = privacy.PrivacyBudget(1.0), []
    for label, epsilon in (("a", 0.4), ("b", 0.5), ("c", 0.2)):
        try:
            budget.consume(epsilon, label=label)
            granted = True
        except ValueError:
            granted = False
        rows.append((label, epsilon, granted, round(budget.remaining, 6)))
    return spark.createDataFrame(rows, "label string, epsilon double, granted boolean, remaining double")


@query("d13_mad", "SELECT event_type, round(mad(value), 6) AS mad FROM events GROUP BY 1")
def d13(spark, sf):
    e = P.table(spark, sf, "events").select("event_type", "value")
    count = lambda d, v: d.groupBy("event_type", v).agg(F.count("*").alias("k"))
    median = frames.quantile_rows(count(e, "value"), ["event_type"], "value", "k", [0.5]).select("event_type", F.col("q")[0].alias("m"))
    away = e.join(F.broadcast(median), "event_type").select("event_type", F.abs(F.col("value") - F.col("m")).alias("away"))
    return rounded(frames.quantile_rows(count(away, "away"), ["event_type"], "away", "k", [0.5]).select("event_type", F.col("q")[0].alias("mad")), "mad")


@query("a16_metrics", values([(m,) for m in ("alpha_beta", "correlation", "downstream", "hif", "ks_test", "moment_matching", "stylized_facts", "tvd")], "metric"))
def a16(spark, sf):
    from .report import list_metrics

    return spark.createDataFrame([(m,) for m in list_metrics()], "metric string")


_TAILS = [("clayton", 2.0), ("clayton", 0.5), ("gumbel", 2.0), ("joe", 3.0), ("frank", 5.0), ("gaussian", 0.7)]


@query("g10_tail_dependence", f"SELECT family, theta, round(CASE WHEN family = 'clayton' THEN pow(2, -1 / theta) ELSE 0 END, 6) AS lower, round(CASE WHEN family IN ('gumbel', 'joe') THEN 2 - pow(2, 1 / theta) ELSE 0 END, 6) AS upper FROM ({values(_TAILS, 'family, theta')})")
def g10(spark, sf):
    rows = [(f, t, *map(float, generate.tail_dependence(f, t))) for f, t in _TAILS]
    return rounded(spark.createDataFrame(rows, "family string, theta double, lower double, upper double"), "lower", "upper")


@query("g07_prior_marginals", "WITH x AS (SELECT avg(p_size) AS m, var_pop(p_size) AS v, 100.0::DOUBLE / (100 + count(*)) AS w FROM part) SELECT round((1 - w) * m + w * 10, 6) AS loc, round(sqrt((1 - w) * v + w * 4), 6) AS scale FROM x")
def g07(spark, sf):
    g = generate.GaussianCopula(prior={"p_size": (10.0, 2.0)}, prior_weight=100.0).fit(P.table(spark, sf, "part").select("p_retailprice", "p_size"))
    m = g.marginals["p_size"]
    return rounded(spark.createDataFrame([(float(m["loc"]), float(m["scale"]))], "loc double, scale double"), "loc", "scale")


_SWEPT = " UNION ALL ".join(f"SELECT {c}::DOUBLE AS min_confidence, * FROM (WITH {P.CU_SQL}, {RULES_SQL.replace('conf >= 0.95', f'conf >= {c}')}, {_BREAK} SELECT (SELECT count(*) FROM rules) AS num_rules, round(1 - 0.9999 * (SELECT count(DISTINCT c_custkey) FROM b) / (SELECT count(*) FROM s), 4) AS score, round((SELECT count(DISTINCT c_custkey) FROM b) / (SELECT count(*) FROM s), 4) AS violation_rate)" for c in (0.95, 0.99, 1.0))


_RUNS = "SELECT event_type AS dataset, 'g' || (user_id % 3) AS generator, event_id % 5 AS seed, 'value' AS measure, value FROM events"


def _runs(spark, sf):
    return P.table(spark, sf, "events").select(F.col("event_type").alias("dataset"), F.concat(F.lit("g"), F.col("user_id") % 3).alias("generator"), (F.col("event_id") % 5).alias("seed"), F.lit("value").alias("measure"), "value")


@query("x21_aggregate", f"SELECT dataset, generator, measure, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem FROM ({_RUNS}) GROUP BY 1, 2, 3")
def x21a(spark, sf):
    return rounded(benchmark.aggregate(_runs(spark, sf)), "mean", "std", "sem")


@query("j09_summary_baseline", f"WITH x AS ({_RUNS}), s AS (SELECT dataset, avg(value) AS mean FROM x GROUP BY 1), b AS (SELECT dataset, avg(value) AS mean FROM x WHERE generator = 'g0' AND dataset <> 'view' GROUP BY 1) SELECT dataset, round(s.mean, 6) AS mean, round(b.mean, 6) AS baseline, round(s.mean - b.mean, 6) AS gain FROM s LEFT JOIN b USING (dataset)")
def j09(spark, sf):
    runs = _runs(spark, sf)
    summary, base = (benchmark.aggregate(d, ("dataset",)) for d in (runs, runs.where("generator = 'g0' and dataset <> 'view'")))
    return rounded(benchmark.against(summary, base, ["dataset"]).select("dataset", "mean", "baseline", "gain"), "mean", "baseline", "gain")


@query("x22_sweep", _SWEPT)
def x22(spark, sf):
    real, syn = P.customers(spark, sf)
    got = benchmark.sweep(real.select(*_NAMES), syn.select(*_NAMES), {"mode": ["rules_only"], "min_confidence": [0.95, 0.99, 1.0]})
    return spark.createDataFrame([(g["min_confidence"], g["num_rules"], float(g["score"]), float(g["violation_rate"])) for g in got], "min_confidence double, num_rules long, score double, violation_rate double")


_ARMS = ", ".join(f"('{a}')" for a in ("all", "not_a_hub"))


@query("x16_leakage_arms", f"WITH {P.CU_SQL}, {RULES_SQL}, {_BREAK} SELECT arm, (SELECT count(*) FROM rules) AS num_rules, round((SELECT count(DISTINCT c_custkey) FROM b) / (SELECT count(*) FROM s), 4) AS violation_rate FROM (VALUES {_ARMS}) t(arm)")
def x16(spark, sf):
    real, syn = P.customers(spark, sf)
    got = benchmark.leakage_arms(real.select(*_NAMES), syn.select(*_NAMES), "c_mktsegment", mode="rules_only")
    return spark.createDataFrame([(k, v["num_rules"], float(v["violation_rate"])) for k, v in got.items() if k != "without"], "arm string, num_rules long, violation_rate double")


# --- coverage, outliers, corruptions, floors ------------------------------------------------------------------------

_KNOWN = " ".join(f"LEFT JOIN p{k} ON p{k}.v = t.{c}" for k, c in enumerate(P.CU_CAT))
_SHARES = ", ".join(f"p{k} AS (SELECT {c} AS v, count(*) / (SELECT count(*) FROM a) AS p FROM a GROUP BY 1)" for k, c in enumerate(P.CU_CAT))
_OWN = ", ".join(f"p{k}.v AS v{k}" for k in range(len(P.CU_CAT)))
_CENTRE = " + ".join(f"CASE WHEN p{k}.v IS NULL THEN 0 ELSE 1 - 2 * p{k}.p END + (SELECT sum(p * p) FROM p{k})" for k in range(len(P.CU_CAT)))
_APART = " + ".join(f"CASE WHEN x.v{k} IS NULL AND y.v{k} IS NULL THEN 0 WHEN x.v{k} IS NULL OR y.v{k} IS NULL THEN 1 WHEN x.v{k} = y.v{k} THEN 0 ELSE 2 END" for k in range(len(P.CU_CAT)))
_ROWS = lambda t: f"SELECT c_custkey AS id, (c_acctbal - m) / sd AS z, {_OWN}, sqrt(pow((c_acctbal - m) / sd, 2) + {_CENTRE}) AS away FROM {t} t CROSS JOIN st {_KNOWN}"
_CURVE = lambda t: f"SELECT greatest(0, 1 - sum(abs(alpha - c)) / sum(alpha)) AS score FROM (SELECT alpha, (SELECT avg((away <= radius)::INTEGER) FROM {t}) AS c FROM radii)"
_NEAR = lambda x, y, own="": f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 12), other) AS k FROM (SELECT x.id AS id, y.id AS other, y.away AS away, sqrt(pow(x.z - y.z, 2) + {_APART}) AS d FROM {x} x, {y} y{own})"


@query("a09_alpha_beta", f"""WITH {P.CU_SQL}, n AS (SELECT least((SELECT count(*) FROM r), (SELECT count(*) FROM s), 10000) AS n),
a AS (SELECT * FROM r ORDER BY md5('42~' || c_custkey::VARCHAR), c_custkey LIMIT (SELECT n FROM n)), b AS (SELECT * FROM s ORDER BY md5('42~' || c_custkey::VARCHAR), c_custkey LIMIT (SELECT n FROM n)),
st AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM a), {_SHARES}, x AS ({_ROWS('a')}), y AS ({_ROWS('b')}),
radii AS (SELECT unnest(range(30)) / 29.0::DOUBLE AS alpha, unnest(quantile_cont(away, [{', '.join(f'{k} / 29.0::DOUBLE' for k in range(30))}])) AS radius FROM x),
rs AS ({_NEAR('x', 'y')}), near AS (SELECT away FROM rs WHERE k = 1), sr AS ({_NEAR('y', 'x')}), ss AS ({_NEAR('y', 'y', ' WHERE x.id <> y.id')})
SELECT round(({_CURVE('y')}), 6) AS alpha_precision, round(({_CURVE('near')}), 6) AS beta_recall, round((SELECT avg((sr.d < ss.d)::INTEGER) FROM sr JOIN ss ON sr.id = ss.id AND sr.k = 1 AND ss.k = 1), 6) AS authenticity""")
def a09(spark, sf):
    return rounded(coverage.coverage(*P.customers(spark, sf), P.CU_NUM, P.CU_CAT, "c_custkey"), "alpha_precision", "beta_recall", "authenticity")


@query("x08_local_outliers", """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT p.id, q.id AS other, list_distance(p.x, q.x) AS d FROM v p, v q WHERE p.id <> q.id),
n AS (SELECT id, other, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 12), other) AS k FROM d) WHERE k <= 20), kd AS (SELECT id, max(d) AS kd FROM n GROUP BY 1),
l AS (SELECT n.id, 1 / greatest(avg(greatest(n.d, kd.kd)), 1e-10) AS lrd FROM n JOIN kd ON kd.id = n.other GROUP BY 1)
SELECT n.id, round(avg(o.lrd) / any_value(l.lrd), 5) AS lof FROM n JOIN l o ON o.id = n.other JOIN l ON l.id = n.id GROUP BY 1""")
def x08(spark, sf):
    return rounded(coverage.local_outlier_factor(P.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))), "lof", digits=5)


@query("x02_conditional_swap", f"""WITH p AS (SELECT p_partkey, p_retailprice, p_size::DOUBLE AS p_size, (p_retailprice > (SELECT quantile_cont(p_retailprice, 0.5) FROM part))::INTEGER AS half FROM part),
o AS (SELECT half, p_size AS z, row_number() OVER (PARTITION BY half ORDER BY md5((49 + half)::VARCHAR || '~' || p_partkey::VARCHAR), p_partkey) AS k, count(*) OVER (PARTITION BY half) AS n FROM p), c AS (SELECT half, count(*) AS n FROM p GROUP BY 1)
SELECT p.p_partkey, p.p_retailprice, CASE WHEN {_chance('p.p_partkey', 42, 'x')} < 0.3 THEN o.z ELSE p.p_size END AS p_size FROM p JOIN c ON c.half = 1 - p.half LEFT JOIN o ON o.half = 1 - p.half AND o.k = floor({_chance('p.p_partkey', 42, 'y')} * c.n) + 1""")
def x02(spark, sf):
    return experiments.conditional_swap(P.table(spark, sf, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size")), "p_partkey", ["p_retailprice", "p_size"], 0.3)


_WITHIN = lambda sql, first: "WITH " + sql.strip().replace("\n", " ", 1) if sql.strip().startswith(first) else sql


@query("x27_reference_floor", f"""WITH {P.CU_SQL.replace('r AS (SELECT', 'even AS (SELECT').split(',' + chr(10) + 's AS')[0]}, o AS (SELECT *, row_number() OVER (ORDER BY md5('42~' || c_custkey::VARCHAR), c_custkey) <= floor(0.5 * (SELECT count(*) FROM even)) AS tr FROM even),
r AS (SELECT * FROM o WHERE tr), s AS (SELECT * FROM o WHERE NOT tr), {numbers(P.CU_NUM)}, {labels(P.CU_CAT)}, ks AS ({_WITHIN(KS_SQL, 'k')}), mm AS ({_WITHIN(MOMENTS_SQL, 'm')}), tv AS ({_WITHIN(TVD_SQL, 'k')})
SELECT 'ks_test' AS measure, round(avg(score), 4) AS value FROM ks UNION ALL SELECT 'moment_matching', round(avg(score), 4) FROM mm UNION ALL SELECT 'tvd', round(avg(score), 4) FROM tv""")
def x27(spark, sf):
    real = P.customers(spark, sf)[0]
    got = benchmark.reference_floor(real, "c_custkey", lambda a, b: benchmark.fidelity_scores(a, b, ["ks_test", "tvd", "moment_matching"]))
    return spark.createDataFrame(sorted(got.items()), "measure string, value double")


@query("a15_report_summary", f"""WITH {P.CU_SQL}, {numbers(P.CU_NUM)}, {labels(P.CU_CAT)}, ks AS ({_WITHIN(KS_SQL, 'k')}), mm AS ({_WITHIN(MOMENTS_SQL, 'm')}), tv AS ({_WITHIN(TVD_SQL, 'k')})
SELECT 'ks_test' AS measure, round(avg(score), 4) AS value FROM ks UNION ALL SELECT 'moment_matching', round(avg(score), 4) FROM mm UNION ALL SELECT 'tvd', round(avg(score), 4) FROM tv""")
def a15(spark, sf) -> DataFrame:
    from .report import fidelity_report

    got = fidelity_report(*P.customers(spark, sf), key="c_custkey", metrics=["ks_test", "tvd", "moment_matching"])
    return spark.createDataFrame([(k, float(v)) for k, v in got["summary"].items() if v is not None], "measure string, value double")


@query("x20_utility")
def x20(spark, sf):
    return downstream.utility(*P.customers(spark, sf), "c_acctbal", "c_custkey")


@query("b02_bin_labels", f"WITH {P.EV_SQL}, e AS (SELECT list_sort(list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])))[2:-2] AS b FROM r) SELECT event_id, 'bin_' || len(list_filter(b, lambda y: s.value >= y)) AS label FROM s, e")
def b02l(spark, sf):
    real, syn = P.events(spark, sf)
    return binning.apply_bins(syn, ["value"], binning.bin_edges(real, ["value"])).select("event_id", F.col("value").alias("label"))
