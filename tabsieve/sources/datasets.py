"""A catalogue of public datasets, their cleaning steps, and a local cache."""

from __future__ import annotations

import copy
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import drop_existing, sample

# Names, fields and places of public datasets.
DATASETS: dict[str, dict] = {
    "census_acs": {"name": "Census ACS Income & Housing", "vertical": "Tax & Income", "source": "US Census ACS 5-Year 2022", "url": "https://api.census.gov/data/2022/acs/acs5", "drop_cols": ["puma"], "rename": {"B19013_001E": "household_income", "B25105_001E": "housing_cost", "B25071_001E": "cost_burden_pct", "B17001_002E": "poverty_count", "B17001_001E": "poverty_total", "B23025_005E": "unemployed_count", "B23025_002E": "labor_force_total", "B25010_001E": "household_size", "B25003_002E": "owner_occupied_count", "B25003_001E": "tenure_total", "B01002_001E": "age_group", "B15003_022E": "bachelors_count", "B15003_001E": "education_total"}, "columns": ["puma", "state", "household_income", "housing_cost", "cost_burden_pct", "poverty_status", "employment_status", "household_size", "tenure", "age_group", "education"]},
    "adult": {"name": "Adult Census Income", "vertical": "Tax & Income", "source": "UCI Machine Learning Repository", "url": "https://archive.ics.uci.edu/ml/machine-learning-databases/adult/adult.data", "drop_cols": ["capital_gain", "capital_loss"], "rename": {}, "columns": ["age", "workclass", "education", "marital_status", "occupation", "relationship", "race", "sex", "capital_gain", "capital_loss", "hours_per_week", "native_country", "income"]},
    "credit": {"name": "Credit Card Default", "vertical": "Financial Services", "source": "UCI Machine Learning Repository", "url": "https://archive.ics.uci.edu/ml/machine-learning-databases/00350/default%20of%20credit%20card%20clients.xls", "drop_cols": [], "rename": {"default payment next month": "default"}, "columns": []},
    "supermarket_sales": {"name": "Supermarket Sales", "vertical": "Retail & E-commerce", "source": "plotly datasets", "url": "https://raw.githubusercontent.com/plotly/datasets/master/supermarket_Sales.csv", "drop_cols": [], "rename": {}, "columns": []},
    "online_purchases": {"name": "Online Purchases", "vertical": "Retail & E-commerce", "source": "public purchase history", "url": "https://raw.githubusercontent.com/ptvan/datasets/master/online_purchases/purchases_2006-2019.csv", "drop_cols": [], "rename": {}, "columns": []},
}
LEAST_ROWS = 100


def list_datasets(vertical: str | None = None) -> list[dict]:
    """Catalogue entries, of one vertical (in any case) if given."""
    return [{"id": k, **copy.deepcopy(v)} for k, v in DATASETS.items() if vertical is None or v["vertical"].lower() == vertical.lower()]


def get_dataset_info(dataset_id: str) -> dict:
    if dataset_id not in DATASETS:
        raise KeyError(f"unknown dataset {dataset_id!r}; known: {sorted(DATASETS)}")
    return copy.deepcopy(DATASETS[dataset_id])


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d["id"], d["name"], d["vertical"], d["source"]) for d in list_datasets()], "id string, name string, vertical string, source string")


def cache_dir() -> str:
    return os.environ.get("TABSIEVE_CACHE") or str(Path.home() / ".cache" / "tabsieve")


def cache_path(dataset_id: str) -> str:
    return f"{cache_dir()}/{dataset_id}.parquet"


def is_cached(dataset_id: str) -> bool:
    return Path(cache_path(dataset_id)).exists()


def load_cached(spark: SparkSession, dataset_id: str) -> DataFrame:
    info = get_dataset_info(dataset_id)
    if not is_cached(dataset_id):
        raise FileNotFoundError(f"{dataset_id} is not cached; download it first")
    return drop_existing(spark.read.parquet(cache_path(dataset_id)), info["drop_cols"])


def load_dataset(spark: SparkSession, dataset_id: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """min(n, rows) hash-sampled rows of a cached dataset of at least 100."""
    df = load_cached(spark, dataset_id)
    if df.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ValueError(f"{dataset_id} has fewer than {LEAST_ROWS} rows")
    keyed = df.withColumn("key_", F.xxhash64(*df.columns))
    return sample(keyed, "key_", n, seed).drop("key_")


def _number(column: str) -> Column:
    return F.expr(f"try_cast(`{column}` as double)")


def clean_census(df: DataFrame) -> DataFrame:
    """Renamed and numeric; shares as ratios; rows with unknown or undefined figures go."""
    info = DATASETS["census_acs"]
    df = df.withColumnsRenamed({k: v for k, v in info["rename"].items() if k in df.columns})
    df = df.withColumns({c: _number(c) for c in df.columns if c in info["rename"].values()})
    over = lambda a, b: F.try_divide(F.col(a), F.col(b))
    df = df.withColumns({"poverty_status": over("poverty_count", "poverty_total"), "employment_status": 1 - over("unemployed_count", "labor_force_total"), "tenure": over("owner_occupied_count", "tenure_total"), "education": over("bachelors_count", "education_total"), "puma": F.col("`public use microdata area`")})
    return df.select(*info["columns"]).na.drop()


def clean_adult(df: DataFrame) -> DataFrame:
    """'?' is missing; rows with missing values go; names with '_'."""
    df = df.select(*[F.trim(F.col(f"`{c}`").cast("string")).alias(c.replace("-", "_")) if t == "string" else F.col(f"`{c}`").alias(c.replace("-", "_")) for c, t in df.dtypes])
    df = df.select(*[F.when(F.col(c) != "?", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    return drop_existing(df, ["fnlwgt", "education_num"]).na.drop()


def clean_credit(df: DataFrame) -> DataFrame:
    """Without ID; lower-case names; code columns as text."""
    df = drop_existing(df, ["ID"])
    df = df.select(*[F.col(f"`{c}`").alias(DATASETS["credit"]["rename"].get(c, c).lower()) for c in df.columns])
    code = [c for c in df.columns if c in ("sex", "education", "marriage", "default") or c.startswith("pay_") and "amt" not in c]
    return df.withColumns({c: F.col(c).cast("string") for c in code})


def clean_supermarket(df: DataFrame) -> DataFrame:
    """Names with '_'; rating numeric; identifiers and dates go."""
    df = df.select(*[F.col(f"`{c}`").alias(c.strip().lower().replace(" ", "_").replace("%", "pct")) for c in df.columns])
    if "rating" in df.columns:
        df = df.withColumn("rating", _number("rating"))
    return drop_existing(df, ["invoice_id", "date", "time", "gross_margin_percentage"])


def clean_purchases(df: DataFrame) -> DataFrame:
    """Amounts without '$' and ','; unknown texts 'Unknown'; dates go."""
    df = df.select(*[F.col(f"`{c}`").alias(c.strip().lower().replace(" ", "_").replace("/", "_")) for c in df.columns])
    amounts = [c for c in df.columns if any(w in c for w in ("price", "total", "tax", "charge", "subtotal"))]
    df = df.withColumns({c: F.expr(f"try_cast(translate(cast(`{c}` as string), '$,', '') as double)") for c in amounts})
    texts = [c for c, t in df.dtypes if t == "string"]
    return drop_existing(df.fillna("Unknown", texts), [c for c in df.columns if "date" in c])


CLEANERS: dict[str, Callable[[DataFrame], DataFrame]] = {"census_acs": clean_census, "adult": clean_adult, "credit": clean_credit, "supermarket_sales": clean_supermarket, "online_purchases": clean_purchases}


def download(spark: SparkSession, dataset_id: str, fetch: Callable[[SparkSession, dict], DataFrame], force: bool = False, n: int = 50_000) -> DataFrame:
    """The cached table, or what fetch(spark, info) returns, cleaned, sampled and cached."""
    info = get_dataset_info(dataset_id)
    if force or not is_cached(dataset_id):
        df = CLEANERS[dataset_id](fetch(spark, info))
        sample(df.withColumn("key_", F.xxhash64(*df.columns)), "key_", n).drop("key_").write.mode("overwrite").parquet(cache_path(dataset_id))
    return load_cached(spark, dataset_id)


def download_all(spark: SparkSession, fetch: Callable, force: bool = False) -> dict[str, str]:
    """'ok' or the failure for each dataset."""
    out = {}
    for d in DATASETS:
        try:
            download(spark, d, fetch, force)
            out[d] = "ok"
        except Exception as e:
            out[d] = f"failed: {e}"
    return out


def status() -> list[dict]:
    return [{"id": d, "cached": is_cached(d), "path": cache_path(d)} for d in DATASETS]
