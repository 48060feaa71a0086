"""Hand-computed values of the statistics, and how operators treat nulls, constants and few rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsieve.functions import distributions
from tabsieve.operators import binning, coverage, downstream, experiments, frames, generate, privacy, rules, statistics, validate, vine
from tabsieve.operators.audit import AuditConfig, Auditor, combine, fuse, integrity_score, sentinel_penalty
from tabsieve.sources import datasets


def one(df):
    return df.collect()[0]


def stack(spark, real, syn, schema, numeric=(), categorical=()):
    return frames.stack(spark.createDataFrame(real, schema), spark.createDataFrame(syn, schema), list(numeric), list(categorical))


def test_ks(spark):
    x = [(i / 99,) for i in range(100)]
    assert one(statistics.kolmogorov(stack(spark, x, x, "a double", ["a"]), ["a"]))["score"] == 1.0
    assert one(statistics.kolmogorov(stack(spark, x, [(v[0] + 5,) for v in x], "a double", ["a"]), ["a"]))["score"] == 0.0
    shifted = one(statistics.kolmogorov(stack(spark, x, [(v[0] + 0.1,) for v in x], "a double", ["a"]), ["a"]))["score"]
    assert shifted == pytest.approx(0.9, abs=1e-9)
    assert statistics.kolmogorov(stack(spark, x[:9], x, "a double", ["a"]), ["a"]).count() == 0
    holes = [*x, (None,), (float("nan"),)]
    assert one(statistics.kolmogorov(stack(spark, holes, x, "a double", ["a"]), ["a"]))["score"] == 1.0


def test_total_variation(spark):
    r = [("a",)] * 70 + [("b",)] * 20 + [("c",)] * 10
    s = [("a",)] * 50 + [("b",)] * 30 + [("c",)] * 20
    assert one(statistics.total_variation(stack(spark, r, s, "k string", (), ["k"]), ["k"]))["score"] == 80.0
    assert one(statistics.total_variation(stack(spark, r, [("z",)], "k string", (), ["k"]), ["k"]))["score"] == 0.0


def test_moments(spark):
    x = [(float(i % 7),) for i in range(60)]
    assert one(statistics.moments(stack(spark, x, x, "a double", ["a"]), ["a"]))["score"] == 100.0
    assert one(statistics.moments(stack(spark, x, [(v[0] + 1,) for v in x], "a double", ["a"]), ["a"]))["score"] < 100
    flat = [(3.0,)] * 20
    assert one(statistics.moments(stack(spark, flat, flat, "a double", ["a"]), ["a"]))["score"] == 100.0


def test_correlation_distance(spark):
    r = [(float(i), float(i)) for i in range(50)]
    s = [(float(i), -float(i)) for i in range(50)]
    d = lambda a, b: one(statistics.correlation_distance(stack(spark, a, b, "a double, b double", ["a", "b"]), ["a", "b"], []))["score"]
    assert d(r, r) == 100.0 and d(r, s) == 0.0
    assert one(statistics.correlation_distance(stack(spark, r, s, "a double, b double", ["a"]), ["a"], []))["score"] == 100.0
    text = spark.createDataFrame([(str(a), str(b)) for a, b in r], "a string, b string")
    both = frames.stack(spark.createDataFrame(r, "a double, b double"), text, ["a", "b"], [])
    assert one(statistics.correlation_distance(both, ["a", "b"], []))["score"] > 90
    flat = stack(spark, [(1.0, float(i)) for i in range(20)], r, "a double, b double", ["a", "b"])
    assert {x["src"]: x["v"] for x in statistics.spearman(flat, "a", "b").collect()}["r"] == 0.0


def test_associations_of_categories(spark):
    r = [("x", "p", 1.0), ("y", "q", 5.0)] * 30
    st = stack(spark, r, r, "a string, b string, n double", ["n"], ["a", "b"])
    assert one(statistics.cramers_v(st, "a", "b"))["v"] == pytest.approx(1.0)
    assert one(statistics.correlation_ratio(st, "a", "n"))["v"] == pytest.approx(1.0)
    const = stack(spark, [("x", "p")] * 20, [("x", "q")] * 20, "a string, b string", (), ["a", "b"])
    assert all(x["v"] == 0.0 for x in statistics.cramers_v(const, "a", "b").collect())


def test_auc(spark):
    auc = lambda rows: one(statistics.auc(spark.createDataFrame(rows, "s double, p boolean"), "s", "p"))["auc"]
    assert auc([(1.0, False), (2.0, True)]) == 1.0 and auc([(2.0, False), (1.0, True)]) == 0.0
    assert auc([(1.0, False), (1.0, True)]) == 0.5 and auc([(1.0, True)]) == 0.5


def test_fills(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, None), (3, 4.0)], "k long, v double")
    got = lambda how, d=df: {r["k"]: r["v"] for r in frames.fill(d, "v", how, 9.0, "k").collect()}
    assert got("mean")[2] == pytest.approx(7 / 3) and got("median")[2] == 2.0 and got("zero")[2] == 0.0
    assert got("value")[2] == 9.0 and got("forward")[2] == 2.0 and 2 not in got("dropna")
    empty = spark.createDataFrame([(0, None), (1, float("nan"))], "k long, v double")
    assert got("mean", empty) == got("median", empty) == got("forward", empty) == {0: 0.0, 1: 0.0}
    first = spark.createDataFrame([(0, None), (1, 5.0), (2, None)], "k long, v double")
    assert got("forward", first) == {0: 5.0, 1: 5.0, 2: 5.0}
    with pytest.raises(ValueError):
        frames.fill(df, "v", "guess")


def test_filters_and_columns(spark):
    f, bad = frames.parse_filters(["A-b:x,y", "n_min:3", "n_max:oops", "plain"])
    assert f == {"a_b": ["x", "y"], "n_min": 3.0} and bad == ["n_max:oops", "plain"]
    df = spark.createDataFrame([("x", 1, 0), ("y", 5, 1), ("z", 9, 2)], "a_b string, n int, id int")
    out, unknown = frames.where_filters(df, f | {"gone": 1})
    assert [r["n"] for r in out.collect()] == [5] and unknown == ["gone"]
    assert frames.shared_columns(df, df) == ["a_b", "n"] and frames.shared_columns(df, df, ["id"]) == ["id"]
    assert frames.resolve_columns(df, {"numeric", "categorical"}) == ["n", "id", "a_b"]
    assert frames.drop_existing(df, ["ID", "none"]).columns == ["a_b", "n"]
    assert [r["code_"] for r in frames.codes(df, "a_b").orderBy("n").collect()] == [0, 1, 2]


def test_bins(spark):
    df = spark.createDataFrame([(float(i), i % 3, "c") for i in range(100)] + [(None, None, None)], "x double, k int, s string")
    e = binning.bin_edges(df, ["x", "k", "s"])
    assert len(e["x"]) == 11 and e["k"] is None and e["s"] is None
    out = binning.apply_bins(spark.createDataFrame([(-5.0, 1, "c"), (99.5, None, None), (float("nan"), 2, "d")], "x double, k int, s string"), ["x", "k", "s"], e).collect()
    assert [tuple(r) for r in out] == [("bin_0", "bin_1", "c"), ("bin_9", None, None), (None, "bin_2", "d")]
    a, b = binning.canonical_codes(spark.createDataFrame([("01",), ("123",)], "c string"), spark.createDataFrame([("7",), ("x",), (None,)], "c string"), ["c"])
    assert [r[0] for r in a.collect()] == ["001", "123"] and [r[0] for r in b.collect()] == ["007", "x", "nan"]
    enc = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "c")], "n double, c string")
    assert len(one(enc.select(binning.encoder(enc, ["n"], ["c"]).alias("x")))["x"]) == 4


def test_rules(spark):
    rows = [("NY", "k1", "r") if i % 2 else ("CA", "k2", "r") for i in range(100)]
    real = spark.createDataFrame(rows, "state string, county string, seg string")
    mined = rules.mine_rules(real, real.columns).collect()
    assert mined and all(r["confidence"] == 1.0 for r in mined)
    assert any(r["antecedent_repr"] == "state=NY" and r["consequent_value"] == "k1" for r in mined)
    bad = spark.createDataFrame([(0, "NY", "k2", "r"), (1, "CA", "k2", "r"), (2, "ZZ", None, "r")], "k long, state string, county string, seg string")
    s = one(rules.violation_summary(bad, mined))
    assert s["num_rows_with_violations"] == 1 and s["rows_evaluated"] == 3 and s["total_rule_hits"] > 0
    assert rules.top_violated(bad, mined).count() > 0 and rules.violation_examples(bad, mined, "k").count() <= 20
    assert rules.mine_rules(real.limit(0), real.columns).count() == 0
    assert one(rules.violation_summary(bad, []))["rule_violation_rate"] == 0.0


def test_fuse(spark):
    row = spark.range(1)
    value = lambda c: one(row.select(c.alias("v")))["v"]
    zero, full = F.lit(0.0), F.lit(1.0)
    assert value(fuse(zero, zero, full)) == pytest.approx(1 - 1e-4 ** (1 / 3))
    assert value(fuse(zero, None, zero, "nic_only")) == 0.0
    assert value(fuse(full, zero, zero, aggregation="arithmetic")) == pytest.approx((1 - 1e-4) / 3)
    assert value(combine([F.lit(0.5), F.lit(0.5)])) == 0.75 and value(sentinel_penalty(F.lit(0.1), 0.2)) == 0.5
    with pytest.raises(ValueError):
        fuse(zero, zero, zero, "some")


def test_auditor(spark):
    rows = [("NY", "k1", float(i % 10)) if i % 2 else ("CA", "k2", float(i % 10) + 50) for i in range(200)]
    real = spark.createDataFrame(rows, "state string, county string, n double")
    a = Auditor(AuditConfig(epochs=5, hubs=1)).fit(real)
    syn = spark.createDataFrame([("NY", "k1", 3.0), ("NY", "k2", 3.0), ("??", "k9", None)], "state string, county string, n double")
    got = a.score(syn).collect()
    assert got[0]["penalty_"] < 0.5 and not got[0]["flagged_"]
    assert got[1]["penalty_"] > 0.5 and got[1]["rule_"] == 1.0 and got[1]["flagged_"]
    flat = spark.createDataFrame([("x",)] * 60, "c string")
    s = integrity_score(flat, flat)
    assert (s["score"], s["violation_rate"]) == (1.0, 0.0)


def test_coverage(spark):
    rows = [(i, float(i % 17), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, x double, c string")
    same = one(coverage.coverage(df, df, ["x"], ["c"], "k"))
    assert same["alpha_precision"] > 0.9 and same["beta_recall"] > 0.9
    distinct = spark.createDataFrame([(i, float(i * i), float(i)) for i in range(60)], "k long, x double, y double")
    assert one(coverage.coverage(distinct, distinct, ["x", "y"], [], "k"))["authenticity"] == 1.0  # copies are nearer to real rows
    collapsed = spark.createDataFrame([(i, 0.0, 0.0) for i in range(60)], "k long, x double, y double")
    got = one(coverage.coverage(distinct, collapsed, ["x", "y"], [], "k"))
    assert got["beta_recall"] < 0.7 and got["authenticity"] < 0.2
    with pytest.raises(ValueError):
        coverage.coverage(df.limit(3), df, ["x"], [], "k")


def test_neighbours_of_whole_base(spark, monkeypatch):
    monkeypatch.setattr(coverage, "MAX_ROWS", 20)
    monkeypatch.setattr(coverage, "BLOCK_VALUES", 60, raising=False)  # several blocks
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(90, 3)), np.ones((40, 3))])  # ids 90 to 129 share one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(i, int(j), r + 1) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), np.round(d[i], 12)))[:4])}
    assert {(r["id"], r["base_id"], r["rank"]) for r in coverage.neighbours(df, df, 4).collect()} == want
    assert coverage.neighbours(df, df.limit(0), 4).count() == 0
    u = df.where("id < 90")
    near = [[j for j in np.argsort(d[i, :90], kind="stable") if j != i][:5] for i in range(90)]
    kd = [d[i, near[i][-1]] for i in range(90)]
    lrd = [1 / np.mean([max(d[i, j], kd[j]) for j in near[i]]) for i in range(90)]
    lof = {r["id"]: r["lof"] for r in coverage.local_outlier_factor(u, 5).collect()}
    assert [lof[i] for i in range(90)] == pytest.approx([np.mean([lrd[j] for j in near[i]]) / lrd[i] for i in range(90)])


def test_privacy(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 101), float(i * 3 % 53), f"c{i % 40}", f"d{i}") for i in range(150)], "k long, x double, y double, c string, d string")
    assert one(privacy.exact_copies(df, df, ["x", "d"]))["risk"] == "very_high"
    got = privacy.privacy_audit(df, df.withColumn("x", F.col("x") + 1000), "k", ["x", "y"], ["c", "d"], n=50)
    assert got["exact_copies"]["n_exact"] == 0 and got["overall_risk"] in privacy.LEVELS
    assert privacy.privacy_audit(df, df, "k", ["x"], ["c", "d"], n=20)["overall_risk"] == "very_high"
    assert [privacy.risk_level(v, privacy.AUC_LIMITS) for v in (0.51, 0.52, 0.6, 0.7, 0.8)] == list(privacy.LEVELS)
    assert one(privacy.singling_out(df, df, ["c"], "k"))["rate"] == 0.0
    budget = privacy.PrivacyBudget(1.0)
    budget.consume(0.6)
    with pytest.raises(ValueError):
        budget.consume(0.6)
    assert budget.spent == pytest.approx(1.2)
    with pytest.raises(ValueError):
        privacy.laplace(F.lit(1.0), 1.0, 0)
    assert sum(r["p"] for r in privacy.private_histogram(df, "c", 5.0).collect()) == pytest.approx(1.0)


def test_validate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)] * 30, "x double")
    got = validate.validate(df)
    assert "58 duplicate rows (96.7%)" in " ".join(got.warnings) and got.ok
    bad = spark.createDataFrame([(None, float("inf"), "c")] * 5 + [(1.0, 2.0, "c")], "a double, b double, c string")
    got = validate.validate(bad, required_columns=["zz"], expected_dtypes={"c": "numeric", "a": "categorical"})
    text = str(got)
    assert not got.ok and all(t in text for t in ("83.3% nulls", "infinite", "missing required", "not numeric", "constant", "too few rows"))


def test_generators(spark):
    rows = [(i % 50, float(math.exp((i * 37 % 100) / 40)), "ab"[i % 2], i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "n int, v double, c string, b boolean")
    g = generate.make_generator("copula")
    with pytest.raises(RuntimeError):
        g.generate(5)
    g.fit(df)
    a, b = g.generate(40, seed=1), g.generate(3, seed=1)
    assert a.columns == ["syn_id", *df.columns] and [f.dataType for f in a.schema.fields[1:]] == [f.dataType for f in df.schema.fields]
    ids = [r["syn_id"] for r in a.collect()] + [r["syn_id"] for r in b.collect()]
    assert ids == [f"SYN-{i}" for i in range(1, 44)]
    assert g.generate(0).count() == 0
    low, high = df.agg(F.min("v"), F.max("v")).first()
    assert all(low <= r["v"] <= high for r in a.collect())
    only = g.generate(20, {"c": "a", "n_min": 10}).collect()
    assert len(only) == 20 and all(r["c"] == "a" and r["n"] >= 10 for r in only)
    assert g.marginal_kinds()["c"] == "categorical" and g.correlation_matrix().shape == (4, 4)
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(200)], "x double, y double")
    got = generate.make_generator("copula").fit(line).generate(500)
    assert got.stat.corr("x", "y") > 0.8
    assert generate.make_generator("vine").fit(line).tail_dependence_report()[0]["tau"] > 0.8
    assert generate.tail_dependence("clayton", 2.0)[0] == pytest.approx(2**-0.5) and generate.tail_dependence("gumbel", 2.0)[1] == pytest.approx(2 - 2**0.5)
    for kind in ("ctgan", "tvae"):
        with pytest.raises(ImportError):
            generate.make_generator(kind)


def test_vine_families():
    with pytest.raises(ValueError):
        generate.make_generator("vine", family_set="odd")
    v = np.random.default_rng(0).uniform(0.01, 0.99, 200)
    for family in vine.FAMILIES["all"]:
        theta = vine.theta_of(family, 0.4)
        assert vine.tau_of(family, theta) == pytest.approx(0.4, abs=1e-3)
        edges = np.stack([vine.conditional(family, theta, np.full(200, u), v, 4) for u in np.linspace(0.01, 0.99, 25)])
        assert (np.diff(edges, axis=0) > -1e-6).all() and edges.min() >= -1e-9 and edges.max() <= 1 + 1e-9
        # the mean over v is the distribution of u
        mean = vine.conditional(family, theta, np.full(4000, 0.3), (np.arange(4000) + 0.5) / 4000, 4).mean()
        assert mean == pytest.approx(0.3, abs=0.01)


def test_vine_finds_families_and_tails(spark):
    rng = np.random.default_rng(2)
    n = 6000
    a, w, z = rng.uniform(size=n), rng.uniform(size=n), rng.uniform(size=n)
    clayton = ((w ** (-3 / 4) - 1) * a**-3.0 + 1) ** (-1 / 3)  # theta 3
    frank = np.clip(-np.log1p(z * np.expm1(-8) / (z + (1 - z) * np.exp(-8 * a))) / 8, 0, 1)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": clayton, "c": 1 - frank, "d": rng.normal(size=n)}))
    g = generate.make_generator("vine").fit(df)
    found = {r["pair"]: r for r in g.tail_dependence_report() if r["tree"] == 1}
    assert found["a x b"]["family"] == "clayton" and found["a x b"]["theta"] == pytest.approx(3, rel=0.15) and found["a x b"]["lower"] > 0.7
    assert found["a x c"]["family"] == "frank" and found["a x c"]["tau"] < -0.5 and found["a x c"]["lower"] == 0
    assert abs(found["a x d"]["tau"]) < 0.05
    got = g.generate(8000).toPandas()
    rank = got[["a", "b", "c", "d"]].rank() / len(got)
    assert ((rank.a < 0.05) & (rank.b < 0.05)).mean() / 0.05 > 0.6 and ((rank.a > 0.95) & (rank.b > 0.95)).mean() / 0.05 < 0.45
    assert rank.a.corr(rank.c) < -0.6 and abs(rank.a.corr(rank.d)) < 0.06
    assert rank.b.corr(rank.c) == pytest.approx(pd.DataFrame({"b": clayton, "c": 1 - frank}).rank().corr().iloc[0, 1], abs=0.07)


def test_quantiles_of_any_size(spark, monkeypatch):
    rows = [(float((i * 7919) % 501), "ab"[i % 2]) for i in range(3000)] + [(None, "a"), (float("nan"), "b")]
    df = spark.createDataFrame(rows, "v double, g string")
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    want = np.quantile([r[0] for r in rows[:3000]], shares)
    assert frames.quantiles(df, ["v"], shares)["v"] == pytest.approx(want)
    monkeypatch.setattr(frames, "BUFFERED", 10)
    assert frames.quantiles(df, ["v"], shares)["v"] == pytest.approx(want)
    assert frames.quantiles(df.limit(0), ["v"], shares) == {"v": None} and frames.quantiles(df, [], shares) == {}


def test_forward_fill_over_many_ranges(spark, monkeypatch):
    rows = [(i, float(i) if i % 9 == 4 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v double")
    last, want = 4.0, {}
    for i, v in rows:
        last = last if v is None else v
        want[i] = last
    got = frames._forward(df, "v", "k", size=50)
    assert {r[0]: r[1] for r in got.select("k", "v").collect()} == want


def test_renderers_and_columns(spark):
    df = spark.createDataFrame([(i, float(i % 17), float(i % 5), "ab"[i % 2], "xyz"[i % 3]) for i in range(120)], "k long, n double, m double, c string, d string")
    text = privacy.format_audit(privacy.privacy_audit(df, df, "k", ["n", "m"], ["c", "d"], n=20))
    assert "exact copies" in text and "very_high" in text and text.count("\n") == 6
    got = spark.createDataFrame([(0.5, 1.0), (0.975, -1.0)], "p double, x double").select(distributions.lognormal_ppf_col(F.col("p"), 1.0, 2.0), distributions.lognormal_cdf_col(F.col("x"))).collect()
    assert got[0][0] == pytest.approx(math.e) and got[1][0] == pytest.approx(math.exp(1 + 2 * 1.959964)) and [r[1] for r in got] == pytest.approx([0.5, 0.0])
    steps = []
    Auditor(AuditConfig(mode="rules_only")).fit(df.select("c", "d"), progress=lambda *a: steps.append(a))
    assert [s[0] for s in steps] == [1, 2, 3]
    with pytest.raises(ValueError):
        Auditor(AuditConfig(mode="nic_only")).fit(df.select("c", F.lit(1.0).alias("one")))


def test_supermarket(spark):
    raw = spark.createDataFrame([("7", 1.5, "x", "4.5", "d"), ("8", 2.5, "y", "?", "d")], "`Invoice ID` string, `Unit price` double, `Product line` string, Rating string, Date string")
    assert [tuple(r) for r in datasets.clean_supermarket(raw).collect()] == [(1.5, "x", 4.5), (2.5, "y", None)]
    census = spark.createDataFrame([tuple(str(k + 1) for k in range(13)) + ("9", "NY")], ", ".join(f"{c} string" for c in datasets.DATASETS["census_acs"]["rename"]) + ", `public use microdata area` string, state string")
    row = datasets.clean_census(census).first()
    assert row["household_income"] == 1.0 and row["poverty_status"] == pytest.approx(4 / 5) and row["employment_status"] == pytest.approx(1 - 6 / 7) and row["puma"] == "9"


def test_utility_variant(spark):
    rows = [(i, float(i % 10), "xyz"[i % 3], "xyz"[i % 3] if i % 10 else "x") for i in range(300)]
    df = spark.createDataFrame(rows, "k long, n double, c string, t string")
    got = downstream.utility(df, df, "t", "k", trees=10).first()
    assert got["f1"] > 0.9 and got["accuracy"] > 0.9 and got["trr"] > 0.9
    assert downstream.utility(df, df, "n", "k", trees=5).first()["f1"] >= 0
    assert [(c, v) for c, v, _ in downstream.aligned_dummies(df, ["c", "t"], most=3)] == [(c, v) for c in "ct" for v in "xyz"]
    assert downstream.aligned_dummies(df, ["c"], most=2) == []


def test_experiments(spark):
    df = spark.createDataFrame([(i, float(i), float(-i), "abc"[i % 3]) for i in range(200)], "k long, x double, y double, c string")
    p = experiments.permute(df, "k", ["x"], 0.5).collect()
    assert sorted(r["x"] for r in p) == sorted(float(i) for i in range(200)) and any(r["x"] != r["k"] for r in p)
    assert experiments.strongest_pair(df, ["x", "y"]) == ("x", "y")
    assert experiments.duplicate_rows(df, "k", ["x"], 0.2).count() > 200
    b = {r["hub"]: r for r in experiments.cell_bounds(df, "c", ["k"]).collect()}
    assert b["a"]["epsilon"] == pytest.approx(b["a"]["n"] ** -0.25)
    d = df.withColumn("t", F.col("x") >= 180).withColumn("f", F.col("x") >= 180)
    m = one(experiments.detection_metrics(d, "f", "x", "t"))
    assert [m[c] for c in m.asDict()] == [1.0] * 5 and one(experiments.matched_f1(d, "x", "t", "k", 0.1))["f1"] == 1.0
    assert one(spark.range(1).select(experiments.identity_error(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("e")))["e"] < 1e-3
    assert experiments.unfinished(df.select("k"), df.where("k < 150").select("k"), ["k"]).count() == 50
