"""Implication rules among categorical items, and rows that break them."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULE = "antecedents array<struct<feature:string,value:string>>, antecedent_repr string, consequent_feature string, consequent_value string, support double, confidence double, lift double, support_count long, antecedent_count long"


def itemsets(real: DataFrame, columns: list[str], size: int, least: int) -> DataFrame:
    """(items, n): sets of up to size (feature, value) items of different columns that at least `least` rows hold.

    Rows are first grouped to distinct combinations; grouping sets then count all column subsets in one pass.
    """
    base = real.select(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in columns]).groupBy(*columns).agg(F.count("*").alias("rows__"))
    sets = [list(s) for k in range(1, size + 1) for s in combinations(columns, k)]
    base.createOrReplaceTempView("tabsieve_items_")
    quoted = lambda s: ", ".join(f"`{c}`" for c in s)
    flags = ", ".join(f"grouping(`{c}`) AS `grouping__{c}`" for c in columns)
    grouped = real.sparkSession.sql(f"SELECT {quoted(columns)}, {flags}, sum(rows__) AS rows__ FROM tabsieve_items_ GROUP BY GROUPING SETS ({', '.join(f'({quoted(s)})' for s in sets)}) HAVING sum(rows__) >= {least}")
    items = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"grouping__{c}") == 0, F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))) for c in columns])))
    return grouped.select(items.alias("items"), F.col("rows__").cast("long").alias("n"))


def mine_rules(real: DataFrame, columns: list[str], min_confidence: float = 0.95, min_support: float = 0.005, max_rules: int = 25, min_lift: float = 1.0, max_antecedents: int = 2) -> DataFrame:
    """The strongest rules 'antecedents => consequent', at most max_rules, by descending confidence, lift, support and wording.

    Support counts at least max(1, ceil(min_support * rows)) rows.  Thresholds apply to unrounded figures.
    """
    rows = real.count()
    spark = real.sparkSession
    if not rows or not columns or max_rules < 1:
        return spark.createDataFrame([], RULE)
    found = itemsets(real, columns, max_antecedents + 1, max(1, math.ceil(min_support * rows))).cache()
    place = found.where(F.size("items") > 1).select("items", "n", F.posexplode("items").alias("k", "head"))
    body = F.filter("items", lambda x, i: i != F.col("k"))
    cand = place.select("head", "n", body.alias("antecedents"))
    counts = found.select(F.col("items").alias("antecedents"), F.col("n").alias("antecedent_count"))
    single = found.where(F.size("items") == 1).select(F.col("items")[0].alias("head"), F.col("n").alias("head_count"))
    out = cand.join(counts, "antecedents").join(single, "head")
    conf = F.col("n") / F.col("antecedent_count")
    lift = conf / (F.col("head_count") / F.lit(rows))
    out = out.where((conf >= min_confidence) & (lift >= min_lift)).select("antecedents", F.array_join(F.transform("antecedents", lambda x: F.concat(x["feature"], F.lit("="), x["value"])), " AND ").alias("antecedent_repr"), F.col("head.feature").alias("consequent_feature"), F.col("head.value").alias("consequent_value"), F.round(F.col("n") / rows, 4).alias("support"), F.round(conf, 4).alias("confidence"), F.round(lift, 4).alias("lift"), F.col("n").alias("support_count"), "antecedent_count")
    return out.orderBy(*[F.desc(c) for c in ("confidence", "lift", "support", "antecedent_repr", "consequent_feature", "consequent_value")]).limit(max_rules)


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("nan"))


def violated(rules: list) -> Column:
    """For each row the numbers of the rules that it breaks: all antecedents hold and the consequent does not."""
    broken = []
    for k, r in enumerate(rules):
        hold = F.lit(True)
        for a in r["antecedents"]:
            hold = hold & (_text(a["feature"]) == F.lit(a["value"]))
        broken.append(F.when(hold & (_text(r["consequent_feature"]) != F.lit(r["consequent_value"])), F.lit(k)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<int>")


def check_rules(synthetic: DataFrame, rules: list) -> DataFrame:
    """synthetic with broken_, the numbers of broken rules; the rules (max_rules at most) become one projection."""
    return synthetic.withColumn("broken_", violated(rules))


def rule_mask(synthetic: DataFrame, real: DataFrame, columns: list[str], **options) -> DataFrame:
    """synthetic with violates_: does the row break a rule that is mined from the real table with these options?"""
    return synthetic.withColumn("violates_", F.size(violated(mine_rules(real, columns, **options).collect())) > 0)  # max_rules at most


def violation_summary(synthetic: DataFrame, rules: list) -> DataFrame:
    n = F.size("broken_")
    return check_rules(synthetic, rules).agg(F.round(F.coalesce(F.avg((n > 0).cast("double")), F.lit(0.0)), 4).alias("rule_violation_rate"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_rule_hits"), F.lit(len(rules)).cast("long").alias("num_rules_mined"), F.count_if(n > 0).alias("num_rows_with_violations"), F.count("*").alias("rows_evaluated"))


def top_violated(synthetic: DataFrame, rules: list, most: int = 10) -> DataFrame:
    """(rule_rank, antecedent_repr, consequent_feature, consequent_value, violation_count), most violated first."""
    spark = synthetic.sparkSession
    table = spark.createDataFrame([(k, r["antecedent_repr"], r["consequent_feature"], r["consequent_value"]) for k, r in enumerate(rules)], "rule_rank int, antecedent_repr string, consequent_feature string, consequent_value string")
    n = check_rules(synthetic, rules).select(F.explode("broken_").alias("rule_rank")).groupBy("rule_rank").agg(F.count("*").alias("violation_count"))
    return n.join(F.broadcast(table), "rule_rank").orderBy(F.desc("violation_count"), "rule_rank").limit(most)


def violation_examples(synthetic: DataFrame, rules: list, key: str, each: int = 3, most: int = 20) -> DataFrame:
    """(row_index, antecedent, expected, actual): the first rows by key that break each rule."""
    wanted = sorted({r["consequent_feature"] for r in rules})
    broken = check_rules(synthetic, rules).select(F.col(key).alias("key_"), F.explode("broken_").alias("rule_"), *[_text(c).alias(f"v_{c}") for c in wanted])
    # The least `each` keys of a rule are found in parts first, not by sorting all its rows.
    actual = F.coalesce(*[F.when(F.col("rule_") == k, F.concat(F.lit(r["consequent_feature"] + "="), F.col(f"v_{r['consequent_feature']}"))) for k, r in enumerate(rules)]) if rules else F.lit(None).cast("string")
    part = broken.select("key_", "rule_", actual.alias("actual"), F.pmod(F.xxhash64("key_"), F.lit(64)).alias("p_"))
    w1, w2 = Window.partitionBy("rule_", "p_").orderBy("key_"), Window.partitionBy("rule_").orderBy("key_")
    first = part.withColumn("n_", F.row_number().over(w1)).where(F.col("n_") <= each).withColumn("n_", F.row_number().over(w2)).where(F.col("n_") <= each)
    table = synthetic.sparkSession.createDataFrame([(k, r["antecedent_repr"], f"{r['consequent_feature']}={r['consequent_value']}") for k, r in enumerate(rules)], "rule_ int, antecedent string, expected string")
    return first.join(F.broadcast(table), "rule_").orderBy("rule_", "key_").limit(most).select(F.col("key_").cast("string").alias("row_index"), "antecedent", "expected", "actual")
