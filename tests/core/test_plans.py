"""Distributions, sources, report, command line, streaming, and the queries against DuckDB."""

import glob
import json
import math
import os

import duckdb
import pytest

from tabsieve import cli
from tabsieve.functions.distributions import beta_inc, bonferroni, normal_cdf, normal_ppf, paired_t, t_cdf, t_ppf, wilcoxon
from tabsieve.operators.audit import AuditConfig, Auditor
from tabsieve.plans import catalogue, report
from tabsieve.sources import datasets, formats
from tabsieve.streaming.scoring import score_stream

SF = "/root/testdata/sf0.001"


def test_distributions():
    assert float(normal_cdf(1.959963985)) == pytest.approx(0.975) and float(normal_ppf(0.975)) == pytest.approx(1.959963985)
    assert t_cdf(2.228, 10) == pytest.approx(0.975, abs=1e-4) and t_ppf(0.975, 10) == pytest.approx(2.228, abs=1e-3)
    assert beta_inc(2, 3, 0.5) == pytest.approx(0.6875)
    assert wilcoxon([1, 2, 3, 4, 5])[1] == pytest.approx(2 / 32) and wilcoxon([0, 0]) == (0.0, 1.0)
    assert paired_t([1, 2, 3], [0, 0, 0])["t"] == pytest.approx(2 / (1 / math.sqrt(3))) and bonferroni([0.01, 0.6]) == [0.02, 1.0]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "x" * 300, None)], "k long, s string, v double")
    for fmt in ("csv", "parquet", "arrow", "json"):
        p = formats.write(df, tmp_path / f"t_{fmt}", fmt)
        assert p.suffix == formats.DEFAULT_SUFFIX[fmt]
        assert {r["k"]: (r["s"], r["v"]) for r in formats.read(spark, p).collect()} == {1: ("a", 1.5), 2: ("x" * 300, None)}
    with pytest.warns(UserWarning):
        p = formats.write(df, tmp_path / "t.dta")
    assert max(len(r["s"]) for r in formats.read(spark, p).collect()) == formats.STATA_TEXT
    assert formats.write(df, tmp_path / "many.parquet", single_file=False).is_dir()
    for bad in (lambda: formats.read(spark, tmp_path / "x.zip"), lambda: formats.read(spark, tmp_path / "x.csv", "odd"), lambda: formats.write(df, tmp_path / "x.sas7bdat"), lambda: formats.check_safe_path("/etc/passwd")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(FileNotFoundError):
        formats.read(spark, tmp_path / "gone.csv")
    assert formats.supported_formats() == sorted({"csv", "parquet", "arrow", "json", "stata", "sas", "excel"})
    formats.append_results(df, str(tmp_path / "log"))
    formats.append_results(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_datasets(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TABSIEVE_CACHE", str(tmp_path))
    assert len(datasets.list_datasets()) == 5 and len(datasets.list_datasets("tax & income")) == 2
    with pytest.raises(KeyError):
        datasets.get_dataset_info("none")
    with pytest.raises(FileNotFoundError):
        datasets.load_cached(spark, "adult")
    raw = spark.createDataFrame([(str(i), " Private ", "?" if i == 0 else "A", i, 1) for i in range(150)], "age string, workclass string, `marital-status` string, capital_gain int, fnlwgt int")
    got = datasets.download(spark, "adult", lambda s, info: raw)
    assert got.count() == 149 and set(got.columns) == {"age", "workclass", "marital_status"}
    assert datasets.load_dataset(spark, "adult", 20).count() == 20
    assert [d for d in datasets.status() if d["cached"]][0]["id"] == "adult"
    assert datasets.download_all(spark, lambda s, i: 1 / 0)["credit"].startswith("failed")
    census = spark.createDataFrame([("1", "2", "100", "0"), ("1", "2", "x", "5")], "B17001_002E string, B17001_001E string, B19013_001E string, B25003_001E string")
    for c in set(datasets.DATASETS["census_acs"]["rename"]) - set(census.columns):
        census = census.selectExpr("*", f"'4' AS {c}")
    census = census.selectExpr("*", "'p' AS `public use microdata area`", "'01' AS state")
    assert datasets.clean_census(census).count() == 0
    credit = datasets.clean_credit(spark.createDataFrame([(1, 2, 3, 4.0)], "ID int, SEX int, PAY_0 int, PAY_AMT1 double"))
    assert dict(credit.dtypes) == {"sex": "string", "pay_0": "string", "pay_amt1": "double"}


def test_report(spark, tmp_path, capsys):
    rows = [(float(i % 13), float(i % 7), "ab"[i % 2], "xy"[i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "n double, m double, c string, d string")
    names = ["ks_test", "moment_matching", "tvd", "correlation", "stylized_facts"]
    got = report.fidelity_report(df, df, metrics=names, include_privacy=True)
    assert got["summary"]["ks_test"] == 1.0 and got["summary"]["tvd"] == 100.0 and not got["failed_metrics"]
    text = report.format_report(got)
    assert "ks_test" in text and "privacy risk" in text

    @report.register("broken")
    def broken(p):
        raise RuntimeError("no")

    try:
        bad = report.fidelity_report(df, df, metrics=["broken", "tvd"], parallel=True)
    finally:
        report._METRICS.pop("broken")
    assert "no" in bad["failed_metrics"]["broken"] and bad["tvd"]["score"] == 100.0
    words = df.select("c", "d")
    assert report.fidelity_report(words, words, metrics=names)["ks_test"] is None
    assert report.json_safe({"a": float("nan")}) == {"a": None}
    with pytest.raises(KeyError):
        report.get_metric("none")
    formats.write(df, tmp_path / "a.csv")
    assert cli.main(["validate", str(tmp_path / "a.csv"), "--min-rows", "10"], spark) == 0
    assert cli.main(["validate", str(tmp_path / "a.csv"), "--required", "zz"], spark) == 1
    out = str(tmp_path / "s.csv")
    assert cli.main(["generate", "--input", str(tmp_path / "a.csv"), "-n", "30", "--filter", "c:a", "--output", out], spark) == 0
    assert {r["c"] for r in formats.read(spark, out).collect()} == {"a"}
    assert cli.main(["list"]) == 0 and cli.main(["info", "adult"]) == 0 and cli.main(["info", "x"]) == 1
    assert cli.main(["download", "--status"]) == 0 and cli.main(["evaluate", "gone.csv", "gone.csv"], spark) == 1
    assert cli.main(["evaluate", out, out, "--rule-min-confidence", "3"], spark) == 1
    assert "adult" in capsys.readouterr().out
    report.save_report(got, str(tmp_path / "r.json"))
    assert json.load(open(tmp_path / "r.json"))["summary"]["tvd"] == 100.0


def test_stream(spark, tmp_path):
    rows = [("NY", "k1") if i % 2 else ("CA", "k2") for i in range(80)]
    df = spark.createDataFrame(rows, "state string, county string")
    a = Auditor(AuditConfig(mode="rules_only")).fit(df)
    spark.createDataFrame([("NY", "k2"), ("NY", "k1")], df.schema).write.parquet(str(tmp_path / "in"))
    q = score_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), a, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["flagged_"] for r in got.collect()) == [False, True]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    value = lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, float) or hasattr(x, "as_tuple") else x
    return sorted((tuple(value(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names = sorted(got.columns)
    columns = [d[0] for d in want.description]
    assert names == sorted(columns)
    rows = [tuple(r[columns.index(c)] for c in names) for r in want.fetchall()]
    assert plain(got.select(*names).collect()) == plain(rows)
