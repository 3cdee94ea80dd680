"""Constraint checks: duplicate keys, missing references, values out of range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _violation(df: DataFrame, rule: str, key: Column, n: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.alias("key"), n.cast("bigint").alias("rows"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return _violation(g, rule, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.col("_n"))


def missing_reference(df: DataFrame, key: str, dim: DataFrame, dim_key: str, rule: str) -> DataFrame:
    """Keys without a row in the dimension; the fact is reduced to its distinct keys first."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    lost = g.join(dim.select(F.col(dim_key).alias(key)), key, "left_anti")
    return _violation(lost, rule, F.col(key).cast("string"), F.col("_n"))


def out_of_range(df: DataFrame, column: str, low: float, high: float, rule: str) -> DataFrame:
    """Values outside [low, high] or NULL, counted by value."""
    c = F.col(column)
    bad = df.filter(c.isNull() | (c < low) | (c > high)).groupBy(c.cast("string").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return _violation(bad, rule, F.col("_k"), F.col("_n"))


def validate(parts: Sequence[DataFrame]) -> DataFrame:
    """All violations in one frame; empty when the data is sound."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
