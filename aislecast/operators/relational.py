"""Joins: interval with wildcards, nearest holiday, look-back, semi and anti selections, dense grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import mean_of


def promotion_days(promotions: DataFrame) -> DataFrame:
    """One row per promotion and day; a promotion is a short interval, so the growth is its length.

    Spark sizes the rows of an explode as those before it, so a join with them names its strategy: they are never sent whole to all tasks.
    """
    return promotions.withColumn("sale_date", F.explode(F.sequence("start_date", "end_date")))


def apply_promotions(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Interval join sale_date in [start, end]; a NULL store or product matches all; the latest start wins.

    The four key shapes (store and product, store, product, neither) are reduced to one winner per key
    and day first, so each becomes an equi left join that never multiplies sales rows.
    """
    best = F.max(F.struct("start_date", "promotion_id", "promotion_type", "discount_percentage"))
    out = sales
    for i, keys in enumerate((["store_id", "product_id"], ["store_id"], ["product_id"], [])):
        absent = [k for k in ("store_id", "product_id") if k not in keys]
        part = promotions
        for k in keys:
            part = part.filter(F.col(k).isNotNull())
        for k in absent:
            part = part.filter(F.col(k).isNull())
        if keys:  # spread before the days are spread out
            part = part.repartition(*keys)
        winner = promotion_days(part).groupBy("sale_date", *keys).agg(best.alias(f"_p{i}"))
        if keys:  # without a key there is one row a calendar day
            winner = winner.hint("merge")
        out = out.join(winner, ["sale_date", *keys], "left")
    win = F.greatest(*[F.col(f"_p{i}") for i in range(4)])
    return (
        out.withColumn("_p", win)
        .withColumns(
            {
                "promotion_id": F.col("_p.promotion_id"),
                "promotion_type": F.col("_p.promotion_type"),
                "promotion_discount": F.coalesce(F.col("_p.discount_percentage"), F.lit(0)),
                "on_promotion": F.col("_p").isNotNull(),
            }
        )
        .drop("_p", *[f"_p{i}" for i in range(4)])
    )


def holiday_distance(days: DataFrame, holidays: DataFrame, default: int = 365) -> DataFrame:
    """Days since the last holiday (that day included) and until the next one, per calendar day.

    ``days`` holds distinct dates, so the ordered pass is over the calendar only; join the result on the date.
    """
    d = days.join(holidays.select(F.col("date").alias("_h")), F.col("sale_date") == F.col("_h"), "left")
    w = W.partitionBy(F.lit(0)).orderBy("sale_date")
    last = F.last("_h", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    nxt = F.first("_h", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return d.select(
        "sale_date",
        F.coalesce(F.date_diff("sale_date", last), F.lit(default)).alias("days_since_holiday"),
        F.coalesce(F.date_diff(nxt, "sale_date"), F.lit(default)).alias("days_until_holiday"),
    )


def holiday_baseline(daily: DataFrame, holidays: DataFrame, keys: Sequence[str], back: int = 14) -> DataFrame:
    """Holiday amount against the mean of the same weekday in the ``back`` days before, per key.

    Each holiday fans out to its look-back days of the same weekday, then meets the daily series by equality.
    """
    weeks = [F.date_sub("date", 7 * i) for i in range(1, back // 7 + 1)]
    look = holidays.select("date", "holiday_name", F.explode(F.array(*weeks)).alias("sale_date"))
    base = (
        daily.join(look, "sale_date")
        .groupBy(*keys, "date")
        .agg(mean_of("sale_amount").alias("baseline_amount"), F.count(F.lit(1)).alias("baseline_days"))
    )
    actual = daily.join(holidays.withColumnRenamed("date", "sale_date"), "sale_date").select(
        *keys, F.col("sale_date").alias("date"), "holiday_name", "sale_amount"
    )
    amount = F.col("sale_amount").cast("double")
    return actual.join(base, [*keys, "date"], "left").withColumns(
        {
            "impact": amount - F.col("baseline_amount"),
            "impact_pct": F.try_divide(amount - F.col("baseline_amount"), F.col("baseline_amount")) * 100,
        }
    )


def recent_or_zero(dim: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Every dimension row with its recent totals, zero where it had none (the fact is filtered before the join)."""
    recent = facts.groupBy(key).agg(
        F.sum("units_sold").alias("units_sold"), F.sum("sale_amount").alias("sale_amount"), F.count(F.lit(1)).alias("rows")
    )
    return dim.join(recent, key, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("units_sold", "sale_amount", "rows")}
    )


def rows_off_promotion(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Sales of products on days without a promotion of that product."""
    days = promotion_days(promotions.filter(F.col("product_id").isNotNull())).select("product_id", "sale_date")
    return sales.join(days.hint("merge"), ["product_id", "sale_date"], "left_anti")


def rows_of_promoted_stores(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Sales of stores that ever ran a promotion of their own of the given kind."""
    stores = promotions.filter(F.col("store_id").isNotNull()).select("store_id")
    return sales.join(stores, "store_id", "left_semi")


def dense_series(daily: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every key on every calendar day between its first and last sale, zero where nothing was sold."""
    span = daily.groupBy(*keys).agg(F.min("sale_date").alias("_a"), F.max("sale_date").alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("sale_date"))
    return grid.join(daily.select(*keys, "sale_date", *values), [*keys, "sale_date"], "left").withColumns(
        {v: F.coalesce(F.col(v), F.lit(0)) for v in values}
    )


def similar_size(metrics: DataFrame, key: str, value: str, target: int, tolerance: float = 0.2) -> DataFrame:
    """Other entities whose metric lies within the tolerance of the target's."""
    goal = metrics.filter(F.col(key) == target).select(value).scalar()
    return metrics.filter(
        (F.col(key) != target) & F.col(value).between(goal * (1 - tolerance), goal * (1 + tolerance))
    )
