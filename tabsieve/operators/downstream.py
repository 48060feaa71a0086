"""Usefulness of synthetic rows for training: train on synthetic, test on real."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binning import encoder
from .frames import categorical_columns, numeric_columns, quantile, split_rows


def macro_f1(scored: DataFrame, label: str = "y", predicted: str = "p") -> DataFrame:
    """(f1): the mean of the classes' F1, over classes that occur as label or prediction."""
    both = scored.groupBy(label, predicted).agg(F.count("*").alias("n"))
    rows = both.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col(label) != F.col(predicted), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col(predicted).alias("c"), F.lit(0).cast("long").alias("tp"), F.when(F.col(label) != F.col(predicted), F.col("n")).otherwise(0).cast("int").alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("e"))
    by = rows.select("e.*").groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return by.agg(F.avg(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("f1"))


def r_squared(scored: DataFrame, label: str = "y", predicted: str = "p") -> DataFrame:
    res = F.sum((F.col(label) - F.col(predicted)) * (F.col(label) - F.col(predicted)))
    return scored.agg((1 - res / F.nullif(F.var_pop(label) * F.count(label), F.lit(0.0))).alias("r2"))


def aligned_dummies(real: DataFrame, columns: list[str], most: int = 50) -> list[tuple[str, str, Column]]:
    """(column, value, 0 or 1) for each value that the real table has in text columns of at most `most` values.

    Applied to another table, values that the real one lacks are zeros everywhere.
    """
    few = real.agg(F.lit(0), *[F.count_distinct(c) for c in columns]).first()[1:]
    columns = [c for c, n in zip(columns, few, strict=True) if n <= most]
    sets = real.agg(F.lit(0), *[F.sort_array(F.collect_set(c)) for c in columns]).first()[1:]  # `most` values a column
    return [(c, v, F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0))) for c, vs in zip(columns, sets, strict=True) for v in vs]


def utility(real: DataFrame, synthetic: DataFrame, target: str, key: str, trees: int = 100, test: float = 0.3, seed: int = 42) -> DataFrame:
    """(f1, accuracy, trr): a forest trained on synthetic rows, judged on held-out real ones; trr is the F1 of one trained on real rows.

    Features are numbers (nulls as 0) and aligned_dummies(); a number of more than two values is split at the real
    median, labels that the real table lacks are left out.
    """
    numeric = [c for c in numeric_columns(real) if c not in (target, key) and c in synthetic.columns]
    texts = [c for c in categorical_columns(real) if c not in (target, key) and c in synthetic.columns]
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric] + [d for _, _, d in aligned_dummies(real, texts)]
    if not parts or target not in synthetic.columns:
        return real.sparkSession.createDataFrame([(None, None, None)], "f1 double, accuracy double, trr double")
    if target in numeric_columns(real):
        values = [r[0] for r in real.select(target).where(F.col(target).isNotNull()).distinct().limit(3).collect()]
        y = (F.col(target) > F.lit(quantile(real, target, 0.5) if len(values) > 2 else min(values, default=0))).cast("double")
    else:
        names = [r[0] for r in real.select(target).where(F.col(target).isNotNull()).distinct().orderBy(target).collect()]
        y = F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(target)), F.lit(0)).cast("double") - 1
    x = array_to_vector(F.array(*parts)).alias("features")
    dealt = split_rows(real, key, 1 - test, seed)
    train, held, own = (d.select(x, y.alias("y")).where("y is not null") for d in (dealt.where("part_ = 'train'"), dealt.where("part_ = 'test'"), synthetic))
    fit = lambda d: RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=10, seed=seed).fit(d).transform(held).select("y", F.col("prediction").alias("p"))
    scored = fit(own).cache()
    accuracy = scored.agg(F.avg((F.col("y") == F.col("p")).cast("double"))).first()[0]
    return real.sparkSession.createDataFrame([(macro_f1(scored).first()[0], accuracy, macro_f1(fit(train)).first()[0])], "f1 double, accuracy double, trr double")


def train_synthetic_test_real(real: DataFrame, synthetic: DataFrame, target: str, key: str, trees: int = 100, test: float = 0.3, seed: int = 42) -> DataFrame:
    """(task, tstr, trr, ratio): score on held-out real rows of a forest trained on synthetic and one on real rows.

    Classification by macro F1 for text targets and up to ten distinct values, else regression by R2.  Rows with
    nulls are left out; labels that the real table lacks are dropped.
    """
    features = [c for c in real.columns if c not in (target, key) and c in synthetic.columns]
    real, synthetic = (d.select(key, target, *features).na.drop() for d in (real, synthetic))
    if real.count() < 50 or synthetic.count() < 10:
        raise ValueError("needs 50 real and 10 synthetic rows")
    dealt = split_rows(real, key, 1 - test, seed)
    train, held = dealt.where("part_ = 'train'"), dealt.where("part_ = 'test'")
    numeric = [c for c in numeric_columns(real) if c in features]
    categorical = [c for c in categorical_columns(real) if c in features]
    vec = array_to_vector(encoder(train, numeric, categorical)).alias("features")
    classes = real.select(target).distinct().limit(11).count()
    if target in categorical_columns(real) or classes <= 10:
        labels = [r[0] for r in real.select(target).distinct().orderBy(target).collect()]
        y = (F.array_position(F.array(*map(F.lit, labels)), F.col(target)) - 1).cast("double").alias("y")
        model = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=10, seed=seed)
        judge, task, low = macro_f1, "classification", 0
    else:
        y = F.col(target).cast("double").alias("y")
        model = RandomForestRegressor(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=10, seed=seed)
        judge, task, low = r_squared, "regression", None
    a, b, c = (d.select(vec, y) for d in (train, held, synthetic))
    if low is not None:
        c = c.where("y >= 0")
        if c.count() < 10:
            raise ValueError("fewer than 10 synthetic rows have labels of the real table")
    run = lambda t: judge(model.fit(t).transform(b).select("y", F.col("prediction").alias("p"))).first()[0]
    tstr, trr = run(c), run(a)
    return real.sparkSession.createDataFrame([(task, float(tstr), float(trr), round(tstr / max(abs(trr), 1e-6), 4))], "task string, tstr double, trr double, ratio double")
