"""Row-level integrity: sentinels, continuity models and rules, fused into one penalty per row."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binning import apply_bins, bin_edges, canonical_codes
from .frames import categorical_columns, folds, numeric_columns, quantile, quantiles
from .rules import mine_rules, violated

#: Rows under which a table is small, and jobs that run side by side.
SMALL, JOBS = 50_000, 8
MODES = ("full", "lse_only", "nic_only", "rules_only", "lse_nic")


@dataclass
class AuditConfig:
    epochs: int = 10
    hubs: int = 5
    depth: int = 12
    confidence_percentile: float = 5.0
    violation_threshold: float = 0.5
    component_floor: float = 1e-4
    mode: str = "full"
    aggregation: str = "geometric"
    min_confidence: float = 0.95
    min_support: float = 0.005
    max_rules: int = 25
    min_lift: float = 1.0
    max_antecedents: int = 2
    cv_splits: int = 5
    high_cardinality: int = 50
    confidence_floor: float = 0.01
    trees_per_epoch: int = 2  # cross-fitted forests need fewer trees than out-of-bag ones
    continuity: str = "forest"  # or 'boosted'
    collapse: float = 0.1
    collapsed_penalty: float = 0.6
    hub_exclude: tuple[str, ...] = ()
    seed: int = 42


def fuse(lse: Column, nic: Column | None, rule: Column, mode: str = "full", aggregation: str = "geometric", floor: float = 1e-4) -> Column:
    """Row penalty, 1 minus the mean validity of the components that the mode uses (all of them, or those it names)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; use one of {MODES}")
    parts = {"full": [lse, nic, rule], "lse_only": [lse], "nic_only": [nic], "rules_only": [rule], "lse_nic": [lse, nic]}[mode]
    valid = [F.least(F.greatest(1 - p, F.lit(floor)), F.lit(1.0)) for p in parts if p is not None]
    if not valid:
        return F.lit(0.0)
    if aggregation == "geometric":
        return 1 - F.exp(reduce(Column.__add__, [F.ln(v) for v in valid]) / len(valid))
    return 1 - reduce(Column.__add__, valid) / len(valid)


def sentinel_penalty(p: Column, floor: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(floor) - p) / F.lit(floor)))


def combine(penalties: list[Column]) -> Column:
    return 1 - reduce(Column.__mul__, [1 - p for p in penalties], F.lit(1.0))


def _encoding(columns: list[str], name: str) -> list:
    """One-hot stages over text columns; unseen categories become a slot of their own, kept by metadata."""
    index = StringIndexer(inputCols=columns, outputCols=[f"{name}i_{c}" for c in columns], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{name}i_{c}" for c in columns], outputCols=[f"{name}v_{c}" for c in columns], dropLast=False, handleInvalid="keep")
    return [index, hot, VectorAssembler(inputCols=[f"{name}v_{c}" for c in columns], outputCol=f"{name}x")]


@dataclass
class Auditor:
    """Fitted on a real table; score() is a projection over any table with the same columns."""

    config: AuditConfig = field(default_factory=AuditConfig)

    def fit(self, real: DataFrame, columns: list[str] | None = None, progress: Callable[[int, int, str], None] | None = None) -> Auditor:
        """Fits on real; progress(step, steps, what) is called before each of three steps, if given."""
        c = self.config
        tell = progress or (lambda *_: None)
        tell(1, 3, "rules")
        columns = columns or real.columns
        self.numeric = [x for x in numeric_columns(real) if x in columns]
        self.categorical = [x for x in categorical_columns(real) if x in columns]
        self.columns = [*self.numeric, *self.categorical]
        self.edges = bin_edges(real, self.columns)
        n = real.agg(*[F.count_distinct(x).alias(x) for x in self.columns]).first()
        self.constant = {x for x in self.numeric if n[x] <= 1}
        self.real = real
        binned = apply_bins(real, self.columns, self.edges, self.constant).select(*self.columns).fillna("nan", self.columns)
        # Equal rows may swap their folds: a hash of the values gives the same folds however the rows are partitioned.
        binned = binned.withColumn("k_", F.xxhash64(*self.columns)).cache()
        found = binned.agg(F.count("*").alias("rows_"), *[F.count_distinct(x).alias(x) for x in self.columns]).first()
        self.rows, self.distinct = found["rows_"], {x: found[x] for x in self.columns}
        if self.rows < SMALL:  # the jobs of a small table run side by side, one task each
            binned = binned.coalesce(1)
        self.rules = mine_rules(binned, self.columns, c.min_confidence, c.min_support, c.max_rules, c.min_lift, c.max_antecedents).collect() if c.mode in ("full", "rules_only") else []
        self.sentinels: dict[str, tuple[PipelineModel, int, float]] = {}  # by hub: model, known values, floor
        self.continuity: dict[str, tuple] = {}
        self.hubs: list[str] = []
        with ThreadPoolExecutor(JOBS) as pool:
            tell(2, 3, "sentinels")
            if c.mode in ("full", "lse_only", "lse_nic"):
                self._fit_sentinels(binned, pool)
            tell(3, 3, "continuity")
            if c.mode in ("full", "nic_only", "lse_nic"):
                self._fit_continuity(real.coalesce(1) if self.rows < SMALL else real, pool)
        if c.mode == "nic_only" and not self.continuity:
            raise ValueError("no numeric column varies, so continuity has nothing to fit")
        return self

    def hub_scores(self, binned: DataFrame) -> list[tuple[str, float]]:
        """Columns by how well the others foretell them, (column, held-out accuracy): in cv_splits folds, the class that
        is most frequent in the other folds among rows that share the value of another column (ties: the greatest),
        for the best other column.  Columns of one class or very many are left out.  All pairs are counted in one pass.
        """
        k = self.config.cv_splits
        usable = [x for x in self.columns if x not in self.config.hub_exclude and self.distinct[x] > 1 and not (self.distinct[x] > self.config.high_cardinality and self.distinct[x] > 0.15 * self.rows)]
        pairs = [(x, y) for y in usable for x in self.columns if x != y]
        best = dict.fromkeys(usable, 0.0)
        if pairs:
            row = F.md5(F.concat_ws("~", *self.columns))  # equal rows are dealt to folds in turn
            turn = F.row_number().over(Window.partitionBy(F.substring(row, 1, 2)).orderBy(row))
            dealt = binned.select(*self.columns, F.pmod(turn - 1, F.lit(k)).alias("fold_"))
            each = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs])).alias("e")
            n = dealt.select("fold_", each).groupBy("e.x", "e.y", "e.u", "e.v").agg(F.count("*").alias("n"), *[F.count_if(F.col("fold_") == f).alias(f"n{f}") for f in range(k)])
            folds_ = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.struct((F.col("n") - F.col(f"n{f}")).alias("rest"), F.col("v"), F.col(f"n{f}").alias("right")).alias("c")) for f in range(k)])).alias("s")
            choice = n.select("x", "y", "u", folds_).where("s.c.rest > 0").groupBy("x", "y", "u", "s.f").agg(F.max("s.c").alias("c"))
            for r in choice.groupBy("x", "y").agg(F.sum("c.right").alias("right")).groupBy("y").agg(F.max("right").alias("right")).collect():  # a row a column
                best[r["y"]] = r["right"] / self.rows
        return sorted(best.items(), key=lambda t: (-t[1], self.columns.index(t[0])))

    def _fit_sentinels(self, binned: DataFrame, pool: ThreadPoolExecutor) -> None:
        c = self.config
        chosen = [h for h, _ in self.hub_scores(binned)[: c.hubs]]
        self.hubs = [h for h in chosen if len(self.columns) > 1]
        if not self.hubs:
            return
        # Columns are encoded once for all sentinels.
        self.encoder = Pipeline(stages=_encoding(self.columns, "s")[:-1]).fit(binned)
        known = dict(zip(self.columns, map(len, self.encoder.stages[0].labelsArray), strict=True))
        coded = self.encoder.transform(binned).cache()
        fits = {}
        for hub in self.hubs:
            others = [x for x in self.columns if x != hub]
            forest = RandomForestClassifier(labelCol=f"si_{hub}", featuresCol="sx", numTrees=max(10, c.epochs * c.trees_per_epoch), maxDepth=c.depth, minInstancesPerNode=5, featureSubsetStrategy="log2", seed=c.seed)
            pipe = Pipeline(stages=[VectorAssembler(inputCols=[f"sv_{x}" for x in others], outputCol="sx"), forest])
            dealt = folds(coded, "k_", hub, 2, c.seed).cache()
            if self.rows < SMALL:
                dealt = dealt.coalesce(1)
            fits[hub] = dealt, known[hub], [pool.submit(pipe.fit, dealt.where(F.col("fold_") != f)) for f in range(2)], pool.submit(pipe.fit, coded)

        def floor_of(hub: str) -> float:
            dealt, n, halves, _ = fits[hub]
            # Probabilities of rows that a forest has not seen stand for out-of-bag ones.
            found = [self._own(m.result(), dealt.where(F.col("fold_") == f), hub, n).select("p_") for f, m in enumerate(halves)]
            return max(float(quantile(found[0].unionByName(found[1]), "p_", c.confidence_percentile / 100) or 0.0), c.confidence_floor)

        models = {hub: fits[hub][3].result() for hub in self.hubs}
        for fit in fits.values():
            wait(fit[2])
        floors = list(pool.map(floor_of, self.hubs))
        self.sentinels = {hub: (models[hub], fits[hub][1], floor) for hub, floor in zip(self.hubs, floors, strict=True)}

    @staticmethod
    def _own(model: PipelineModel, coded: DataFrame, hub: str, known: int) -> DataFrame:
        """Encoded rows with p_, the probability of the hub's own value; 0 for values never seen."""
        own = F.get(vector_to_array("probability"), F.col(f"si_{hub}").cast("int"))
        return model.transform(coded).select(*coded.columns, F.when(F.col(f"si_{hub}") < known, own).otherwise(0.0).alias("p_"))

    @staticmethod
    def _observed(model: PipelineModel, df: DataFrame, hub: str) -> DataFrame:
        """df with p_, the probability of the hub's own value; 0 for values never seen."""
        labels = model.stages[-2].labels
        out = model.transform(df)
        place = F.array_position(F.array(*map(F.lit, labels)), F.col(hub)) - 1
        own = F.get(vector_to_array("probability"), place.cast("int"))
        drop = [x for x in out.columns if x not in df.columns and x != "p_"]
        return out.withColumn("p_", F.when(place >= 0, own).otherwise(0.0)).drop(*[d for d in drop])

    def _fit_continuity(self, real: DataFrame, pool: ThreadPoolExecutor) -> None:
        c = self.config
        targets = [x for x in self.numeric if x not in self.hubs and x not in self.constant]
        stats = real.agg(F.lit(0), *[f(x) for x in targets for f in (F.avg, F.stddev_pop)]).first()[1:]

        def model_of(y: str, m: float | None, sd: float | None) -> tuple | None:
            context = self.categorical or [x for x in self.columns if x != y]
            if not context or not sd:
                return None
            rows = self._with_context(real, context).where(F.col(y).isNotNull()).withColumn("z_", (F.col(y).cast("double") - m) / sd)
            kind = GBTRegressor(labelCol="z_", featuresCol="cx", maxIter=100, maxDepth=5, stepSize=0.1, minInstancesPerNode=20, seed=c.seed) if c.continuity == "boosted" else RandomForestRegressor(labelCol="z_", featuresCol="cx", numTrees=20, maxDepth=5, minInstancesPerNode=20, seed=c.seed)
            model = Pipeline(stages=[*_encoding([f"t_{x}" for x in context], "c"), kind]).fit(rows)
            res = model.transform(rows).select(F.abs(F.col("z_") - F.col("prediction")).alias("r"), "prediction").cache()
            spread = res.agg(F.stddev_pop("prediction")).first()[0]
            p95, p98, med = quantiles(res, ["r"], [0.95, 0.98, 0.5])["r"]
            mad = quantile(res.select(F.abs(F.col("r") - med).alias("r")), "r", 0.5)
            res.unpersist()
            z = max(p95, med + 2 * mad)
            return model, context, m, sd, z, max(p98, 2 * z, 3 * mad, 0.1), spread < c.collapse

        done = pool.map(model_of, targets, stats[::2], stats[1::2])
        self.continuity = {y: fit for y, fit in zip(targets, done, strict=True) if fit}

    def _with_context(self, df: DataFrame, context: list[str]) -> DataFrame:
        text = apply_bins(df.select("*", *[F.col(x).alias(f"o_{x}") for x in context]), context, self.edges, self.constant)
        return text.select("*", *[F.coalesce(F.col(x), F.lit("nan")).alias(f"t_{x}") for x in context]).withColumns({x: F.col(f"o_{x}") for x in context}).drop(*[f"o_{x}" for x in context])

    def score(self, df: DataFrame) -> DataFrame:
        """df with lse_, nic_, rule_ (0 to 1), penalty_ and flagged_; map-only."""
        c = self.config
        own = df.columns
        out = df.select("*", *[F.col(x).alias(f"raw_{x}") for x in self.columns])
        out = apply_bins(out, self.columns, self.edges, self.constant).fillna("nan", self.columns)
        penalties = []
        if self.sentinels:
            out = self.encoder.transform(out)
        for k, (hub, (model, known, floor)) in enumerate(self.sentinels.items()):
            out = self._own(model, out, hub, known).withColumn(f"pen_{k}", sentinel_penalty(F.col("p_"), floor)).drop("p_")
            penalties.append(F.col(f"pen_{k}"))
        out = out.withColumn("lse_", combine(penalties) if penalties else F.lit(0.0))
        out = out.withColumn("rule_", F.when(F.size(violated(self.rules)) > 0, 1.0).otherwise(0.0) if self.rules else F.lit(0.0))
        out = out.withColumns({x: F.col(f"raw_{x}") for x in self.columns}).select(*own, "lse_", "rule_")
        nic = []
        for k, (y, (model, context, m, sd, z, gamma, collapsed)) in enumerate(self.continuity.items()):
            if collapsed:
                value = F.lit(c.collapsed_penalty)
                out = out.withColumn(f"nic_{k}", F.when(F.col(y).isNotNull(), value).otherwise(0.0))
            else:
                names = out.columns
                moved = model.transform(self._with_context(out, context))
                res = F.abs((F.col(y).cast("double") - m) / sd - F.col("prediction"))
                out = moved.withColumn(f"nic_{k}", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (res - z) / gamma)), F.lit(0.0))).select(*names, f"nic_{k}")
            nic.append(F.col(f"nic_{k}"))
        out = out.withColumn("nic_", F.greatest(F.lit(0.0), *nic) if nic else F.lit(0.0))
        penalty = fuse(F.col("lse_"), F.col("nic_") if nic else None, F.col("rule_"), c.mode, c.aggregation, c.component_floor)
        return out.select(*own, "lse_", "nic_", "rule_", penalty.alias("penalty_")).withColumn("flagged_", F.col("penalty_") > c.violation_threshold)


def summary(scored: DataFrame) -> DataFrame:
    """(score, lse, nic, rules, violation_rate, rows): means over a scored table."""
    m = lambda c: F.round(1 - F.avg(c), 4)
    return scored.agg(m("penalty_").alias("score"), m("lse_").alias("lse"), m("nic_").alias("nic"), m("rule_").alias("rules"), F.round(F.avg(F.col("flagged_").cast("double")), 4).alias("violation_rate"), F.count("*").alias("rows"))


def integrity_score(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None, **options) -> dict:
    """Fit on the real table, score the synthetic one."""
    auditor = Auditor(AuditConfig(**options)).fit(real, columns)
    out = summary(auditor.score(synthetic)).first().asDict()
    return out | {"hubs": list(auditor.sentinels), "floors": {h: s[2] for h, s in auditor.sentinels.items()}, "num_rules": len(auditor.rules)}


__all__ = ["AuditConfig", "Auditor", "canonical_codes", "combine", "fuse", "integrity_score", "sentinel_penalty", "summary"]
