"""Hourly arrays (24 slots): peak, shares, day-part labels, text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import ratio


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def array_mean_positive(a: Column) -> Column:
    pos = F.filter(a, lambda x: x > 0)
    return ratio(array_sum(pos), F.size(pos))


def peak_hour(a: Column) -> Column:
    """Index of the first maximum; NULL for an empty or NULL array."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1).cast("int")


def zero_share(a: Column) -> Column:
    """Share of zero slots; 0 for an empty or NULL array."""
    zeros = F.size(F.filter(a, lambda x: x == 0))
    return F.when(F.coalesce(F.size(a), F.lit(0)) > 0, zeros / F.size(a)).otherwise(0.0)


def hourly_metrics(df: DataFrame) -> DataFrame:
    """Length, total, mean of positives, peak, peak hour, peak intensity, active hours, hours out of stock."""
    a, s = F.col("hours_sale"), F.col("hours_stock_status")
    return df.withColumns(
        {
            "hours_with_data": F.size(a),
            "total_hourly_sales": array_sum(a),
            "avg_hourly_sales": array_mean_positive(a),
            "peak_hourly_sales": F.array_max(a),
            "peak_hour": peak_hour(a),
            "peak_intensity": ratio(F.array_max(a), array_sum(a) / F.size(a)),
            "hours_active": F.size(F.filter(a, lambda x: x > 0)),
            "total_stockout_hours": F.size(F.filter(s, lambda x: x == 0)),
        }
    )


def shopping_part(peak: Column) -> Column:
    return F.when(peak.isNull(), "unknown").when(peak < 10, "morning").when(peak < 15, "afternoon").otherwise("evening")


def daily_pattern(peak: Column) -> Column:
    return (
        F.when(peak.isNull(), "Normal")
        .when(peak < 6, "Morning_Peak")
        .when(peak > 12, "Evening_Peak")
        .otherwise("Midday_Peak")
    )


def parse_hours(text: Column) -> Column:
    """Array from its JSON text; an unreadable text gives an empty array."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def explode_hours(df: DataFrame) -> DataFrame:
    """One row per hour from the two aligned arrays."""
    return df.select(
        "sale_date",
        "store_id",
        "product_id",
        F.posexplode(F.arrays_zip("hours_sale", "hours_stock_status")).alias("hour_of_day", "_h"),
    ).select(
        "sale_date",
        "store_id",
        "product_id",
        "hour_of_day",
        F.col("_h.hours_sale").alias("sales_amount"),
        (F.col("_h.hours_stock_status") == 1).alias("stock_available"),
    )
