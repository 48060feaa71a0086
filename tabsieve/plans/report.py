"""The scorecard: metrics over a pair of tables, their summary, JSON and text."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, coverage, downstream, privacy, statistics
from ..operators.frames import categorical_columns, numeric_columns, shared_columns, stack

_METRICS: dict[str, Callable] = {}


def register(name: str) -> Callable:
    """Adds a metric: a function of a Pair that returns a dict."""

    def add(f: Callable) -> Callable:
        _METRICS[name] = f
        return f

    return add


def list_metrics() -> list[str]:
    return list(_METRICS)


def get_metric(name: str) -> Callable:
    if name not in _METRICS:
        raise KeyError(f"unknown metric {name!r}; known: {list(_METRICS)}")
    return _METRICS[name]


class Pair:
    """Two conformed tables with their roles, stacked once for all metrics."""

    def __init__(self, real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None, target: str | None = None, key: str | None = None, options: dict | None = None):
        cols = [c for c in shared_columns(real, synthetic, columns) if c != key]
        self.numeric = [c for c in numeric_columns(real) if c in cols]
        self.categorical = [c for c in categorical_columns(real) if c in cols]
        self.columns, self.target, self.options = cols, target, options or {}
        self.key = key or "key_"
        add = (lambda d: d) if key else (lambda d: d.withColumn("key_", F.monotonically_increasing_id()))
        self.real, self.synthetic = add(real), add(synthetic)
        self.stacked = stack(real, synthetic, self.numeric, self.categorical).cache()


def _per_column(scores: DataFrame) -> dict:
    rows = scores.select("col", "score").collect()  # a row a column
    each = {r[0]: r[1] for r in rows}
    return {"columns": each, "score": round(sum(each.values()) / len(each), 4) if each else 0.0}


@register("alpha_beta")
def _alpha_beta(p: Pair) -> dict:
    return coverage.coverage(p.real, p.synthetic, p.numeric, p.categorical, p.key).first().asDict()


@register("correlation")
def _correlation(p: Pair) -> dict:
    pair = statistics.associations(p.stacked, p.numeric, p.categorical) if len(p.columns) > 1 else None
    deltas = {}
    if pair is not None:
        rows = pair.groupBy("i", "j").agg(F.round(F.abs(F.coalesce(F.max(F.when(F.col("src") == "r", F.col("v"))), F.lit(0.0)) - F.coalesce(F.max(F.when(F.col("src") == "s", F.col("v"))), F.lit(0.0))), 4).alias("d")).collect()
        deltas = {f"{r['i']} × {r['j']}": r["d"] for r in rows}
    return {"score": statistics.correlation_distance(p.stacked, p.numeric, p.categorical).first()[0], "pairwise_deltas": deltas}


@register("downstream")
def _downstream(p: Pair) -> dict | None:
    if not p.target:
        return None
    return downstream.train_synthetic_test_real(p.real, p.synthetic, p.target, p.key).first().asDict()


@register("hif")
def _integrity(p: Pair) -> dict:
    return audit.integrity_score(p.real.select(*p.columns), p.synthetic.select(*p.columns), p.columns, **p.options.get("audit", {}))


@register("ks_test")
def _ks(p: Pair) -> dict | None:
    return _per_column(statistics.kolmogorov(p.stacked, p.numeric)) if p.numeric else None


@register("moment_matching")
def _moments(p: Pair) -> dict | None:
    return _per_column(statistics.moments(p.stacked, p.numeric)) if p.numeric else None


@register("stylized_facts")
def _stylised(p: Pair) -> dict | None:
    n = p.stacked.groupBy("src").count().agg(F.min("count")).first()[0] or 0
    if not p.numeric or n < 50:
        return None
    t = _per_column(statistics.tails(p.stacked, p.numeric))["columns"]
    c = _per_column(statistics.concentration(p.stacked, p.numeric))["columns"]
    parity = statistics.predictive_parity(p.stacked, p.numeric).first()[0]
    all_ = [*t.values(), *c.values(), *([] if parity is None else [parity])]
    return {"tails": t, "concentration": c, "parity": parity, "score": round(sum(all_) / len(all_), 2), "applicable": True}


@register("tvd")
def _tvd(p: Pair) -> dict | None:
    return _per_column(statistics.total_variation(p.stacked, p.categorical)) if p.categorical else None


def json_safe(x):
    """Numbers that JSON lacks become null."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [json_safe(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x


def fidelity_report(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None, target: str | None = None, key: str | None = None, include_privacy: bool = False, parallel: bool = False, metrics: list[str] | None = None, dataset_type: str = "cross_sectional", **options) -> dict:
    """Runs the metrics; one that fails is recorded under failed_metrics and the others stand."""
    pair = Pair(real, synthetic, columns, target, key, options)
    out: dict = {"dataset_type": dataset_type, "failed_metrics": {}}

    def run(name: str):
        try:
            return name, get_metric(name)(pair), None
        except Exception as e:
            return name, None, f"{type(e).__name__}: {str(e)[:300]}"

    names = metrics or list_metrics()
    if parallel:
        with ThreadPoolExecutor(4) as pool:
            done = list(pool.map(run, names))
    else:
        done = [run(n) for n in names]
    for name, value, failure in done:
        out[name] = value
        if failure:
            out["failed_metrics"][name] = failure
    if include_privacy:
        try:
            out["privacy"] = privacy.privacy_audit(pair.real, pair.synthetic, pair.key, pair.numeric, pair.categorical)
        except Exception as e:
            out["failed_metrics"]["privacy"] = str(e)[:300]
    out["summary"] = {k: (out.get(k) or {}).get(f) for k, f in (("ks_test", "score"), ("moment_matching", "score"), ("tvd", "score"), ("correlation", "score"), ("stylized_facts", "score"), ("hif", "score"), ("downstream", "ratio"), ("alpha_beta", "alpha_precision"))}
    return json_safe(out)


def format_report(report: dict, width: int = 60) -> str:
    """Text with a bar for each score and column; sections that were skipped are left out."""
    out = ["=" * width, "Fidelity report".center(width), "=" * width]
    full = {"ks_test": 1.0, "hif": 1.0, "alpha_beta": 1.0, "downstream": 1.0}

    def bar(label: str, score: float, top: float) -> str:
        k = max(0, min(20, round(20 * score / top)))
        return f"{label[:28]:<28} {'#' * k}{'.' * (20 - k)} {score:.3f}"

    for name, score in (report.get("summary") or {}).items():
        if score is not None:
            out.append(bar(name, score, full.get(name, 100.0)))
            out += [bar(f"  {c}", s, full.get(name, 100.0)) for c, s in ((report.get(name) or {}).get("columns") or {}).items()]
    out += [f"failed: {k}: {v}" for k, v in (report.get("failed_metrics") or {}).items()]
    if report.get("privacy"):
        out.append(f"privacy risk: {report['privacy']['overall_risk']} ({report['privacy']['recommendation']})")
    return "\n".join(out)


def save_report(report: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(json_safe(report), f, indent=2, default=str)
