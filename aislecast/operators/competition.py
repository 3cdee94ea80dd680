"""Market view by category: profile, threats, openings, pricing, size, strength."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import clamp, ladder, mean_if, mean_of, ratio, std_of


def _all():
    """One window over all categories: a handful of labels, so a bounded group."""
    return W.partitionBy(F.lit(0))


def category_profile(sales: DataFrame, min_rows: int = 30, unit_price: float = 25.0) -> DataFrame:
    """Revenue, spread, coverage and place of each category."""
    g = sales.groupBy("first_category").agg(
        F.count(F.lit(1)).alias("_n"),
        mean_of("units_sold").alias("avg_sales"),
        std_of("units_sold").alias("sales_std"),
        F.count_distinct("store_id").alias("store_coverage"),
        F.count_distinct("product_id").alias("product_variety"),
        (F.sum("units_sold") * unit_price).alias("estimated_revenue"),
    ).filter(F.col("_n") >= min_rows)
    return g.withColumn("revenue_rank", F.rank().over(_all().orderBy(F.desc("estimated_revenue")))).drop("_n")


def threats(sales: DataFrame, as_of: dt.date, recent: int = 14, span: int = 45, min_rows: int = 20, decline: float = 0.10, unit_price: float = 25.0) -> DataFrame:
    """Categories whose recent mean fell by more than ``decline``."""
    d, u = F.col("sale_date"), F.col("units_sold")
    new = d >= F.lit(as_of - dt.timedelta(days=recent))
    old = d.between(F.lit(as_of - dt.timedelta(days=span)), F.lit(as_of - dt.timedelta(days=recent)))
    g = sales.groupBy("first_category").agg(
        F.count(F.lit(1)).alias("_n"),
        mean_if(new, u).alias("recent_avg"),
        mean_if(old, u).alias("baseline_avg"),
        (F.sum(u) * unit_price).alias("revenue"),
    ).filter((F.col("_n") >= min_rows) & (F.col("baseline_avg") > 0))
    g = g.withColumn("change", (F.col("recent_avg") - F.col("baseline_avg")) / F.col("baseline_avg")).filter(F.col("change") < -decline)
    rate = F.abs("change")
    g = g.withColumns({"severity": ladder(rate, [(0.25, "critical"), (0.15, "high")], "medium", op=">"), "impact": F.col("revenue") * rate})
    return g.withColumn("urgency", F.when(F.col("severity") == "critical", 5).when(F.col("severity") == "high", 4).otherwise(3)).drop("_n")


def opportunities(
    sales: DataFrame, min_rows: int = 20, max_share: float = 0.15, min_products: int = 5, unit_price: float = 25.0, category: str = "first_category"
) -> DataFrame:
    """Small categories with enough products, with their places by performance and revenue."""
    g = sales.groupBy(category).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_distinct("product_id").alias("product_count"),
        (F.sum("units_sold") * unit_price).alias("total_revenue"),
        mean_of("units_sold").alias("avg_performance"),
    ).filter(F.col("_n") >= min_rows)
    total = g.agg(F.sum("total_revenue")).scalar()
    g = g.withColumns(
        {
            "market_share": ratio("total_revenue", total),
            "performance_rank": F.rank().over(_all().orderBy("avg_performance")),
            "revenue_rank": F.rank().over(_all().orderBy(F.desc("total_revenue"))),
        }
    ).filter((F.col("market_share") < max_share) & (F.col("product_count") >= min_products))
    return g.withColumns(
        {
            "revenue_potential": F.col("total_revenue") * 1.5,
            "success_probability": F.least(F.lit(0.85), F.lit(0.4) + F.col("product_count") / 20),
            "difficulty": ladder("product_count", [(15, "low"), (10, "medium")], "high"),
            "importance": ladder("market_share", [(0.05, "high"), (0.10, "medium")], "low", op="<"),
        }
    ).drop("_n")


def pricing(sales: DataFrame, min_rows: int = 20, unit_price: float = 25.0, tiers=((75, "premium"), (40, "mid_market"), (20, "value"))) -> DataFrame:
    """Transaction value, tier, volume share and price pressure of each category."""
    v = F.col("units_sold") * unit_price
    g = sales.filter(F.col("units_sold") > 0).groupBy("first_category").agg(
        F.count(F.lit(1)).alias("sample_size"),
        (mean_of("units_sold") * unit_price).alias("avg_value"),
        F.stddev_samp(v.cast("double")).alias("value_std"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.sum("units_sold").alias("total_volume"),
    ).filter(F.col("sample_size") >= min_rows)
    total = g.agg(F.sum("total_volume")).scalar()
    return g.withColumns(
        {
            "pricing_tier": ladder("avg_value", list(tiers), "budget", op=">"),
            "volume_share": ratio("total_volume", total),
            "pricing_pressure": F.when(F.col("value_std") > F.col("avg_value") * 0.3, "high").otherwise("moderate"),
        }
    )


def market_size(sales: DataFrame, multiplier: float = 3.5, unit_price: float = 25.0) -> DataFrame:
    """Own revenue, share of the business and assumed market size per category."""
    g = sales.groupBy("first_category").agg(
        F.sum("units_sold").alias("units"),
        (F.sum("units_sold") * unit_price).alias("revenue"),
        F.count_distinct("store_id").alias("stores"),
        F.count_distinct("product_id").alias("products"),
    )
    total = g.agg(F.sum("revenue")).scalar()
    return g.withColumns(
        {
            "category_share": ratio("revenue", total),
            "estimated_market": F.col("revenue") * multiplier,
            "position": F.when(ratio("revenue", total) > 0.15, "challenger").otherwise("follower"),
        }
    )


def strength(threat_rows: DataFrame, opportunity_rows: DataFrame, high_value: float = 40000.0) -> DataFrame:
    """70 less penalties for threats plus bonuses for openings, held within 20..95."""
    sev = F.col("severity")
    pen = threat_rows.agg(
        F.coalesce(F.sum(F.when(sev == "critical", 10).when(sev == "high", 5).otherwise(0)), F.lit(0)).alias("penalty")
    )
    bonus = opportunity_rows.agg(
        (F.count_if(F.col("revenue_potential") > high_value) * 5 + F.count_if(F.col("importance") == "high") * 3).alias("bonus")
    )
    score = pen.withColumn("bonus", bonus.scalar())
    return score.withColumn("strength", clamp(70 - F.col("penalty") + F.col("bonus"), 20, 95))
