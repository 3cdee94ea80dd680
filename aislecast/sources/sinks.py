"""Writers: exports, keyed upserts, result tables with JSON payloads, partitioned forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """CSV with header, JSON lines or parquet; nested columns become JSON text in CSV."""
    if kind == "csv":
        nested = ("array", "map", "struct")
        cols = [F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes]
        df.select(*cols).write.mode(mode).csv(path, header=True)
    elif kind == "json":
        df.write.mode(mode).json(path)
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(kind)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The old rows whose key is not in ``new``, plus ``new``; ``versioned.upsert`` writes that for the touched buckets only."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def overwrite_days(df: DataFrame, path: str, day: str) -> None:
    """Replaces only the partitions of the days present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def with_payload(df: DataFrame, keys: Sequence[str], name: str = "payload") -> DataFrame:
    """Key columns with all others packed as JSON text."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias(name))


def append_results(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    with_payload(df, keys).write.mode("append").parquet(path)


def write_forecasts(forecast: DataFrame, path: str, by: Sequence[str] = ("city_id",)) -> None:
    """Forecast rows as JSON lines under one folder per key; rows of a key are brought together first."""
    forecast.repartition(*by).write.mode("overwrite").partitionBy(*by).json(path)


def write_canonical_sales(sales: DataFrame, path: str) -> None:
    """Canonical sales by month of sale, sorted by series within files, so that scans prune days and series."""
    monthly = sales.withColumn("sale_month", F.trunc("sale_date", "month"))
    # a month may be far larger than a task: spread it by store before the write
    spread = F.pmod(F.xxhash64("store_id"), F.lit(64))
    monthly.repartition("sale_month", spread).sortWithinPartitions("sale_month", "store_id", "product_id", "sale_date").write.mode(
        "overwrite"
    ).partitionBy("sale_month").parquet(path)
