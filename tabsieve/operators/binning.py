"""Quantile bins, bin labels, code columns and one-hot encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import quantiles

BINS = 10


def bin_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> dict[str, list[float] | None]:
    """Inner and outer quantile edges of each numeric column, duplicates dropped.

    None for columns that are not numeric or have no more distinct values than bins.
    """
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType | T.BooleanType)]
    if not numeric:
        return dict.fromkeys(columns)
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in numeric}
    row = df.agg(*[F.count_distinct(x[c]).alias(f"n_{c}") for c in numeric]).first()
    many = [c for c in numeric if row[f"n_{c}"] > bins]
    found = quantiles(df, many, [k / bins for k in range(bins + 1)])
    return {c: sorted(set(found[c])) if c in many else None for c in columns}


def bin_label(column: str, edges: list[float], prefix: str = "bin_") -> Column:
    """Left-closed bins with open ends, as text; null stays null."""
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    place = F.lit(0)
    for e in edges[1:-1]:
        place = place + F.when(x >= F.lit(e), 1).otherwise(0)
    return F.when(x.isNotNull(), F.concat(F.lit(prefix), place.cast("string")))


def apply_bins(df: DataFrame, columns: list[str], edges: dict[str, list[float] | None], constant: set[str] | None = None) -> DataFrame:
    """df with each column as text: bins, bin_<value> for numbers with few values, bin_0 for constant ones (as found in
    the real table), and other columns as they are."""
    out = {}
    for c in columns:
        kind = df.schema[c].dataType
        if edges.get(c):
            out[c] = bin_label(c, edges[c])
        elif isinstance(kind, T.NumericType):
            out[c] = F.when(F.col(c).isNotNull(), F.lit("bin_0") if c in (constant or ()) else F.concat(F.lit("bin_"), F.col(c).cast("string")))
        else:
            out[c] = F.col(c).cast("string")
    return df.withColumns(out)


def interval_label(column: str, edges: list[float]) -> Column:
    """Right-closed intervals '(a, b]' as text; the first also holds its lower edge."""
    x = F.col(column).cast("double")
    out = F.lit(None).cast("string")
    for a, b in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
        out = F.when(x <= F.lit(b), F.lit(f"({a}, {b}]")).otherwise(out)
    return F.when(x >= F.lit(edges[0]), out)


def canonical_codes(real: DataFrame, synthetic: DataFrame, columns: list[str], missing: str = "nan") -> tuple[DataFrame, DataFrame]:
    """Both tables with columns as text; where all real values are digits, shorter ones are zero-padded to the real
    table's longest in both.  Null becomes a category of its own."""
    x = {c: F.col(c).cast("string") for c in columns}
    row = real.agg(*[F.coalesce(F.min(x[c].rlike("^[0-9]+$")), F.lit(False)).alias(f"d_{c}") for c in columns], *[F.max(F.length(x[c])).alias(f"n_{c}") for c in columns]).first()
    out = {}
    for c in columns:
        n = row[f"n_{c}"] or 0
        padded = F.when(x[c].rlike("^[0-9]+$") & (F.length(x[c]) < n), F.lpad(x[c], n, "0")).otherwise(x[c]) if row[f"d_{c}"] else x[c]
        out[c] = F.coalesce(padded, F.lit(missing))
    return real.withColumns(out), synthetic.withColumns(out)


def encoder(real: DataFrame, numeric: list[str], categorical: list[str]) -> Column:
    """A vector (array of doubles): numbers with nulls as the median, standardised; categories one-hot with nulls as the
    most frequent one (the smallest of ties) and unknown ones as zeros.  Fitted on the real table."""
    med = {c: q[0] if q else 0.0 for c, q in quantiles(real, numeric, [0.5]).items()}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in numeric}
    stats = real.agg(F.lit(0), *[F.avg(filled[c]).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(filled[c]).alias(f"s_{c}") for c in numeric], *[F.mode(F.col(c), True).alias(f"o_{c}") for c in categorical], *[F.sort_array(F.collect_set(c)).alias(f"v_{c}") for c in categorical]).first()
    parts = [(filled[c] - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in numeric]
    for c in categorical:
        x = F.coalesce(F.col(c), F.lit(stats[f"o_{c}"]))
        parts += [F.when(x == F.lit(v), 1.0).otherwise(0.0) for v in stats[f"v_{c}"]]
    return F.array(*parts)
