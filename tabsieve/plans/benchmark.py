"""Runs over many settings: generators and seeds, hyper-parameters, ablations, leakage arms, reference floors."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit
from ..operators.binning import apply_bins, bin_edges
from ..operators.experiments import group_summary, unfinished
from ..operators.frames import folds, quantile, split_rows
from ..operators.generate import make_generator
from .report import fidelity_report


def run_matrix(spark, tables: dict[str, DataFrame], generators: Iterable[str], seeds: Iterable[int], path: str, score: Callable[[DataFrame, DataFrame], dict[str, float]], n: int = 1000) -> DataFrame:
    """Scores of every (table, generator, seed); each is appended when done, and a restart skips what the table at path holds."""
    jobs = spark.createDataFrame(list(product(tables, generators, seeds)), "dataset string, generator string, seed long")
    shape = "dataset string, generator string, seed long, measure string, value double"
    spark.createDataFrame([], shape).write.mode("append").parquet(path)
    for dataset, generator, seed in unfinished(jobs, spark.read.schema(shape).parquet(path), ["dataset", "generator", "seed"]).orderBy("dataset", "generator", "seed").collect():
        real = tables[dataset]
        values = score(real, make_generator(generator).fit(real).generate(n, seed=seed).drop("syn_id"))
        spark.createDataFrame([(dataset, generator, seed, k, float(v)) for k, v in values.items()], shape).write.mode("append").parquet(path)
    return spark.read.schema(shape).parquet(path)


def aggregate(results: DataFrame, keys: tuple[str, ...] = ("dataset", "generator", "measure")) -> DataFrame:
    """(keys..., n, mean, std, sem) of a results table over its seeds."""
    return group_summary(results, list(keys), "value")


def against(summary: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """summary with baseline, the mean of the same keys in another summary (null where it has none), and gain, the difference."""
    other = baseline.select(*keys, F.col("mean").alias("baseline"))
    return summary.join(other, keys, "left").withColumn("gain", F.col("mean") - F.col("baseline"))


def fidelity_scores(real: DataFrame, synthetic: DataFrame, metrics: list[str] | None = None) -> dict[str, float]:
    return {k: v for k, v in fidelity_report(real, synthetic, metrics=metrics)["summary"].items() if v is not None}


def sweep(real: DataFrame, synthetic: DataFrame, grid: dict[str, list]) -> list[dict]:
    """Integrity scores for every combination of audit options."""
    return [dict(zip(grid, values, strict=True)) | audit.integrity_score(real, synthetic, **dict(zip(grid, values, strict=True))) for values in product(*grid.values())]


def ablation(scored: DataFrame, has_continuity: bool, threshold: float = 0.5) -> DataFrame:
    """(mode, score, violation_rate) for all modes from one scored table."""
    nic = F.col("nic_") if has_continuity else None
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), audit.fuse(F.col("lse_"), nic, F.col("rule_"), m).alias("p")) for m in audit.MODES])
    return scored.select(F.explode(modes).alias("m")).groupBy(F.col("m.mode").alias("mode")).agg((1 - F.avg("m.p")).alias("score"), F.avg((F.col("m.p") > threshold).cast("double")).alias("violation_rate"))


def leakage_arms(real: DataFrame, synthetic: DataFrame, target: str, **options) -> dict[str, dict]:
    """Integrity scores with all columns, with the target barred as a hub, and without the target."""
    rest = [c for c in real.columns if c != target]
    return {"all": audit.integrity_score(real, synthetic, **options), "not_a_hub": audit.integrity_score(real, synthetic, hub_exclude=(target,), **options), "without": audit.integrity_score(real.select(*rest), synthetic.select(*rest), **options)}


def label_noise(real: DataFrame, target: str, trees: int = 20, percentile: float = 5.0, seed: int = 42) -> DataFrame:
    """real with p_, the cross-fitted probability of its own label, and noisy_, whether that is under its percentile."""
    others = [c for c in real.columns if c != target]
    row = real.withColumn("row_", F.xxhash64(*real.columns)).where(F.col(target).isNotNull())
    text = apply_bins(row.select("*", *[F.col(c).alias(f"own_{c}") for c in others]), others, bin_edges(real, others)).fillna("nan", others).withColumn("label_", F.col(target).cast("string"))
    dealt = folds(text, "row_", "label_", 2, seed).cache()
    index = StringIndexer(inputCol="label_", outputCol="y_", handleInvalid="keep", stringOrderType="alphabetAsc")
    pipe = Pipeline(stages=[*audit._encoding(others, "s"), index, RandomForestClassifier(labelCol="y_", featuresCol="sx", numTrees=trees, maxDepth=8, minInstancesPerNode=5, seed=seed)])
    parts = [audit.Auditor._observed(pipe.fit(dealt.where(F.col("fold_") != f)), dealt.where(F.col("fold_") == f), "label_") for f in range(2)]
    both = parts[0].unionByName(parts[1])
    floor = quantile(both, "p_", percentile / 100) or 0.0
    return both.select(*[F.col(f"own_{c}").alias(c) if c in others else F.col(c) for c in real.columns], "p_", (F.col("p_") < F.lit(floor)).alias("noisy_"))


def reference_floor(real: DataFrame, key: str, score: Callable[[DataFrame, DataFrame], dict[str, float]], seed: int = 42) -> dict[str, float]:
    """What the scores are when one half of the real rows stands for synthetic ones."""
    both = split_rows(real, key, 0.5, seed)
    a, b = (both.where(F.col("part_") == p).drop("part_", key) for p in ("train", "test"))
    return score(a, b)
