"""Table checks in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class ValidationResult:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    stats: dict = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return not self.errors

    def __str__(self) -> str:
        return "\n".join([f"{'valid' if self.ok else 'invalid'}: {len(self.errors)} errors, {len(self.warnings)} warnings", *[f"error: {e}" for e in self.errors], *[f"warning: {w}" for w in self.warnings]])


def profile(df: DataFrame) -> DataFrame:
    """(col, n_null, n_distinct, n_inf, n) for each column."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        real = isinstance(f.dataType, T.DoubleType | T.FloatType)
        gone = c.isNull() | F.isnan(c) if real else c.isNull()
        inf = F.count_if(F.abs(c) == float("inf")) if real else F.lit(0).cast("long")
        aggs.append(F.struct(F.lit(f.name).alias("col"), F.count_if(gone).alias("n_null"), F.count_distinct(F.when(~gone, c)).alias("n_distinct"), inf.alias("n_inf"), F.count("*").alias("n")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def duplicates(df: DataFrame) -> DataFrame:
    """(n_duplicates): rows beyond the first of each distinct one."""
    return df.groupBy(*df.columns).agg((F.count("*") - 1).alias("extra__")).agg(F.coalesce(F.sum("extra__"), F.lit(0)).cast("long").alias("n_duplicates"))


def validate(df: DataFrame, min_rows: int = 50, min_cols: int = 1, required_columns: list[str] | None = None, expected_dtypes: dict[str, str] | None = None, max_null: float = 0.3, max_cardinality: int = 500, max_duplicate: float = 0.05) -> ValidationResult:
    out = ValidationResult()
    if not df.columns:
        out.errors.append("table has no columns")
        return out
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = {c for c, t in kinds.items() if isinstance(t, T.NumericType)}
    rows = profile(df).collect()
    n = rows[0]["n"]
    out.stats = {"n_rows": n, "n_cols": len(df.columns), "nulls": {}, "distinct": {}}
    if n < min_rows:
        out.errors.append(f"too few rows: {n} < {min_rows}")
    if len(df.columns) < min_cols:
        out.errors.append(f"too few columns: {len(df.columns)} < {min_cols}")
    gone = [c for c in required_columns or [] if c not in kinds]
    if gone:
        out.errors.append(f"missing required columns: {gone}")
    for c, kind in (expected_dtypes or {}).items():
        if c in kinds and kind == "numeric" and c not in numeric:
            out.errors.append(f"column '{c}' is not numeric")
        if c in kinds and kind == "categorical" and c in numeric:
            out.warnings.append(f"column '{c}' is numeric, not categorical")
    for r in rows:
        share = r["n_null"] / n if n else 0.0
        out.stats["nulls"][r["col"]] = round(share, 4)
        out.stats["distinct"][r["col"]] = r["n_distinct"]
        if share > max_null:
            out.errors.append(f"column '{r['col']}' has {share * 100:.1f}% nulls")
        if n and r["n_null"] == n:
            out.warnings.append(f"column '{r['col']}' is all null")
        elif r["n_distinct"] <= 1:
            out.warnings.append(f"column '{r['col']}' is constant")
        if r["col"] not in numeric and r["n_distinct"] > max_cardinality:
            out.warnings.append(f"column '{r['col']}' has {r['n_distinct']} distinct values")
        if r["n_inf"] and n - r["n_null"] >= 4:
            out.errors.append(f"column '{r['col']}' has infinite values")
    d = duplicates(df).first()[0]
    out.stats["duplicates"] = d
    if n and d / n > max_duplicate:
        out.warnings.append(f"{d} duplicate rows ({d / n * 100:.1f}%)")
    return out
