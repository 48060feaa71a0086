"""Runs over many settings."""

from tabsieve.plans import benchmark


def test_matrix_resumes(spark, tmp_path):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(80)], "x double, c string")
    calls = []

    def score(real, syn):
        calls.append(1)
        return {"rows": syn.count()}

    path = str(tmp_path / "runs")
    assert benchmark.run_matrix(spark, {"t": df}, ["copula"], [1, 2], path, score, n=10).count() == 2
    got = benchmark.run_matrix(spark, {"t": df}, ["copula", "empirical"], [1, 2], path, score, n=10)
    assert got.count() == 4 and len(calls) == 4 and {r["value"] for r in got.collect()} == {10.0}


def test_label_noise(spark):
    rows = [("a", "x") if i % 2 else ("b", "y") for i in range(100)] + [("a", "y")] * 2
    got = benchmark.label_noise(spark.createDataFrame(rows, "f string, label string"), "label", trees=10)
    assert got.count() == 102 and got.columns == ["f", "label", "p_", "noisy_"]
    low = got.groupBy("f", "label").avg("p_").collect()
    p = {(r[0], r[1]): r[2] for r in low}
    assert p["a", "y"] < p["a", "x"]
