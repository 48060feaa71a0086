"""Roles of columns, conformed pairs of tables, long form, hash-ordered samples and fills."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that identify rows and say nothing about them (fixed value; compared in lower case).
IDENTIFIERS = ("syn_id", "id", "row_id", "index", "uid", "uuid", "tract_id", "serial_no", "fips_code", "ip_address")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def shared_columns(real: DataFrame, synthetic: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns of both tables in the order of the real one, without identifiers; asked-for columns are taken as they are."""
    have = set(synthetic.columns)
    if columns is not None:
        return [c for c in columns if c in real.columns and c in have]
    return [c for c in real.columns if c in have and c.lower() not in IDENTIFIERS]


def resolve_columns(real: DataFrame, kinds: set[str]) -> list[str]:
    """Numeric columns first, then categorical ones."""
    return (numeric_columns(real) if "numeric" in kinds else []) + (categorical_columns(real) if "categorical" in kinds else [])


def conform(df: DataFrame, numeric: list[str], categorical: list[str], keep: list[str] | None = None) -> DataFrame:
    """Numeric columns as doubles with NaN as null, categorical ones as strings."""
    cols = [F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double")).alias(c) for c in numeric]
    return df.select(*(keep or []), *cols, *[F.col(f"`{c}`").cast("string").alias(c) for c in categorical])


def stack(real: DataFrame, synthetic: DataFrame, numeric: list[str], categorical: list[str], keep: list[str] | None = None) -> DataFrame:
    """Both tables, conformed, under a column src ('r' or 's')."""
    parts = [conform(d, numeric, categorical, keep).withColumn("src", F.lit(s)) for d, s in ((real, "r"), (synthetic, "s"))]
    return parts[0].unionByName(parts[1])


def long_form(stacked: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """(ids..., col, v) of the non-null values of some columns of one type."""
    return stacked.unpivot(ids or ["src"], columns, "col", "v").where("v is not null")


def hash_order(key: Column, seed: int) -> Column:
    """A text that orders rows at random but always alike: md5 of seed~key."""
    return F.md5(F.concat(F.lit(f"{seed}~"), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the first by hash order."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def split_rows(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """df with part_: 'train' for the first int(n * share) rows by hash order, else 'test'.

    The boundary is found from counts of hash prefixes, so no task sorts all rows.
    """
    h = df.withColumn("h_", hash_order(F.col(key), seed))
    n = df.count()
    want = int(n * share)
    counts = h.groupBy(F.substring("h_", 1, 3).alias("p_")).agg(F.count("*").alias("n_")).orderBy("p_").collect()  # 4,096 rows at most
    before, edge = 0, None
    for p, k in counts:
        if before + k > want:
            edge = p
            break
        before += k
    if edge is None:
        return h.withColumn("part_", F.lit("train")).drop("h_")
    rest = want - before
    inside = h.where(F.substring("h_", 1, 3) == edge).select("h_", key).orderBy("h_", key).limit(rest).agg(F.max(F.struct("h_", key))).first()[0] if rest else None
    prefix = F.substring("h_", 1, 3)
    train = prefix < edge
    if inside is not None:
        train = train | ((prefix == edge) & ((F.col("h_") < inside[0]) | ((F.col("h_") == inside[0]) & (F.col(key) <= inside[1]))))
    return h.withColumn("part_", F.when(train, "train").otherwise("test")).drop("h_")


def folds(df: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """df with fold_, 0 to k-1, dealt within each label by hash order."""
    w = Window.partitionBy(label).orderBy(hash_order(F.col(key), seed), key)
    return df.withColumn("fold_", F.pmod(F.row_number().over(w) - 1, F.lit(k)).cast("int"))


FILLS = ("dropna", "mean", "median", "zero", "forward", "value")


def running(n: DataFrame, by: list[str], order: str, sums: list[str], parts: int | None = None) -> DataFrame:
    """n with run_<c> for each of sums: its running total over ascending `order` within `by`, the row itself included.

    `order` must be distinct within `by`.  Values are dealt to ranges of about equally many rows, so that no task sorts
    a whole column; only range totals (parts + 1 for each group) are summed in one place.  There are as many ranges as
    shuffle partitions, 64 to 1,000, unless given.
    """
    parts = parts or min(1000, max(64, int(n.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    marks = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    edges = n.groupBy(*by).agg(F.percentile_approx(order, marks, F.lit(max(2000, 10 * parts))).alias("edges_"))  # a row a group
    x = n.join(F.broadcast(edges), by).withColumn("range_", F.size(F.filter("edges_", lambda e: e < F.col(order)))).drop("edges_")
    total = x.groupBy(*by, "range_").agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    w = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(*by, "range_", *[F.coalesce(F.sum(f"t_{c}").over(w), F.lit(0)).alias(f"before_{c}") for c in sums])
    own = Window.partitionBy(*by, "range_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"own_{c}": F.sum(c).over(own) for c in sums}).join(F.broadcast(before), [*by, "range_"])
    return x.withColumns({f"run_{c}": F.col(f"own_{c}") + F.col(f"before_{c}") for c in sums}).drop("range_", *[f"own_{c}" for c in sums], *[f"before_{c}" for c in sums])


#: Rows whose distinct values one aggregation buffer holds; quantiles of more come from running totals over ranges.
BUFFERED = 1_000_000


def _between(low: Column, high: Column, place: Column) -> Column:
    return low + (high - low) * (place - F.floor(place))


def quantile_rows(n: DataFrame, by: list[str], value: str, count: str, shares: list[float]) -> DataFrame:
    """(by..., q): exact quantiles, linear between neighbouring rows, from counts by distinct value.

    Running totals over ranges of values replace a buffer of all distinct values, so any number of them will do.
    """
    total = n.groupBy(*by).agg(F.sum(count).alias("total_"))  # a row a group
    run = running(n.select(*by, value, count), by, value, [count]).join(F.broadcast(total), by)
    place = lambda q: F.lit(float(q)) * (F.col("total_") - 1)
    first = lambda at: F.min(F.when(F.col(f"run_{count}") > at, F.col(value)))
    got = run.groupBy(*by, "total_").agg(*[first(f(place(q))).alias(f"{k}_{i}") for i, q in enumerate(shares) for k, f in (("lo", F.floor), ("hi", F.ceil))])
    return got.select(*by, F.array(*[_between(F.col(f"lo_{i}"), F.col(f"hi_{i}"), place(q)) for i, q in enumerate(shares)]).alias("q"))


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of numeric columns, linear between neighbouring rows; None for a column without values.

    Nulls and NaN are left out.  Up to BUFFERED rows are taken in one aggregation, more by counts of their values; the
    results are the same.
    """
    x = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    if not columns:
        return {}
    if x.limit(BUFFERED + 1).count() <= BUFFERED:
        row = x.agg(*[F.percentile(F.col(f"`{c}`"), F.array(*map(F.lit, map(float, shares)))) for c in columns]).first()
        return {c: list(v) if v else None for c, v in zip(columns, row, strict=True)}
    n = x.unpivot([], columns, "col", "v").where("v is not null").groupBy("col", "v").agg(F.count("*").alias("k"))
    found = {r["col"]: list(r["q"]) for r in quantile_rows(n, ["col"], "v", "k", shares).collect()}  # a row a column
    return {c: found.get(c) for c in columns}


def quantile(df: DataFrame, column: str, share: float) -> float | None:
    """One exact quantile of a column."""
    return (quantiles(df, [column], [share])[column] or [None])[0]


def fill(df: DataFrame, column: str, how: str = "dropna", value: float | None = None, order: str | None = None) -> DataFrame:
    """A numeric column without nulls: dropped, or filled by mean, median, zero, a value, or the nearest row before.

    mean and median of a column of nulls are 0.  'forward' needs an order column; what precedes the first value takes
    the first value, or 0 if there is none.
    """
    c = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    df = df.withColumn(column, c)
    if how == "dropna":
        return df.where(F.col(column).isNotNull())
    if how == "zero":
        return df.withColumn(column, F.coalesce(column, F.lit(0.0)))
    if how == "value":
        if value is None:
            raise ValueError("fill method 'value' needs a value")
        return df.withColumn(column, F.coalesce(column, F.lit(float(value))))
    if how in ("mean", "median"):
        stat = df.agg(F.avg(column)).first()[0] if how == "mean" else quantile(df, column, 0.5)
        return df.withColumn(column, F.coalesce(column, F.lit(float(stat or 0.0))))
    if how == "forward":
        if order is None:
            raise ValueError("fill method 'forward' needs an order column")
        return _forward(df, column, order)
    raise ValueError(f"unknown fill method {how!r}; use one of {FILLS}")


def _forward(df: DataFrame, column: str, order: str, size: int = 10_000, most: int = 10_000) -> DataFrame:
    """Carries values forward over ranges of the order column; only each range's last value crosses ranges.

    There is a range for every `size` rows, up to `most`; rows find theirs among the edges in two steps.
    """
    parts = max(1, min(most, df.count() // size))
    edges = sorted(set(df.stat.approxQuantile(order, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    step = max(1, math.isqrt(len(edges)))
    groups = [edges[k : k + step] for k in range(0, len(edges), step)] or [[]]
    passed = lambda values: F.size(F.filter(values, lambda e: e < F.col(order)))
    if edges:
        heads = F.array(*[F.lit(g[0]) for g in groups])
        coarse = F.greatest(passed(heads) - 1, F.lit(0))
        df = df.withColumn("part_", coarse * step + passed(F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), coarse)))
    else:
        df = df.withColumn("part_", F.lit(0))
    last = df.where(F.col(column).isNotNull()).groupBy("part_").agg(F.max_by(column, order).alias("v_"), F.min_by(column, order).alias("f_")).collect()  # a row a range
    known = {r[0]: r[1] for r in last}
    carried, rows = min(((r[0], r[2]) for r in last), default=(0, 0.0))[1], []
    for p in range(len(edges) + 1):
        rows.append((p, float(carried)))
        carried = known.get(p, carried)
    before = df.sparkSession.createDataFrame(rows, "part_ int, carried_ double")
    inside = F.last(column, ignorenulls=True).over(Window.partitionBy("part_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("inside_", inside).join(F.broadcast(before), "part_").withColumn(column, F.coalesce("inside_", "carried_")).drop("part_", "inside_", "carried_")


def standardise(df: DataFrame, columns: list[str], eps: float = 1e-9) -> DataFrame:
    """z-scores with the population deviation; a deviation under eps counts as 1."""
    stats = df.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]).first()
    out = {c: (F.col(c) - F.lit(stats[f"{c}_m"])) / F.lit(stats[f"{c}_s"] if (stats[f"{c}_s"] or 0) >= eps else 1.0) for c in columns}
    return df.withColumns(out)


def where_filters(df: DataFrame, filters: dict[str, object]) -> tuple[DataFrame, list[str]]:
    """Rows that pass exact, in-list, <column>_min and <column>_max filters; and the keys that match no column."""
    unknown = []
    for key, value in filters.items():
        base, _, side = key.rpartition("_")
        if key in df.columns:
            df = df.where(F.col(f"`{key}`").isin(list(value)) if isinstance(value, list | tuple | set) else F.col(f"`{key}`") == F.lit(value))
        elif side in ("min", "max") and base in df.columns:
            df = df.where(F.col(f"`{base}`") >= F.lit(value) if side == "min" else F.col(f"`{base}`") <= F.lit(value))
        else:
            unknown.append(key)
    return df, unknown


def parse_filters(texts: list[str]) -> tuple[dict[str, object], list[str]]:
    """key:value texts as filters (keys in lower case, '-' as '_'; _min and _max are numbers; commas make a list); and bad ones."""
    out: dict[str, object] = {}
    bad = []
    for t in texts:
        key, colon, value = t.partition(":")
        if not colon:
            bad.append(t)
            continue
        key = key.strip().lower().replace("-", "_")
        if key.endswith(("_min", "_max")):
            try:
                out[key] = float(value)
            except ValueError:
                bad.append(t)
        else:
            out[key] = [v.strip() for v in value.split(",")] if "," in value else value.strip()
    return out, bad


def drop_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    names = {c.lower() for c in columns}
    return df.drop(*[c for c in df.columns if c.lower() in names])


def codes(df: DataFrame, column: str) -> DataFrame:
    """df with code_: the place of a category in ascending order, -1 for null."""
    order = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    place = F.lit(-1)
    for i, v in enumerate(order):
        place = F.when(F.col(column) == v, i).otherwise(place)
    return df.withColumn("code_", place)
