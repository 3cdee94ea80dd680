"""Customer value, lifecycle, shopping patterns and preferences."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import ladder, mean_if, mean_of, ratio, std_of, sum_if


def rfm(purchases: DataFrame, as_of: dt.date, min_purchases: int = 5, money: tuple = (2000, 1000, 500, 200)) -> DataFrame:
    """Recency, frequency and money scores of each customer; ``purchases`` has customer_id, store_id, category, day, value."""
    g = purchases.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.sum("value").alias("monetary_value"),
        mean_of("value").alias("avg_value"),
        F.date_diff(F.lit(as_of), F.max("day")).alias("recency_days"),
        F.count_distinct("category").alias("category_diversity"),
        F.count_distinct("store_id").alias("store_loyalty"),
        std_of("value").alias("spending_std"),
    ).filter(F.col("frequency") >= min_purchases)
    return g.withColumns(
        {
            "recency_score": ladder("recency_days", [(7, 5), (14, 4), (30, 3), (60, 2)], 1, op="<="),
            "frequency_score": ladder("frequency", [(20, 5), (15, 4), (10, 3), (5, 2)], 1),
            "monetary_score": ladder("monetary_value", [(m, 5 - i) for i, m in enumerate(money)], 1),
        }
    )


def segment_name(r: Column, f: Column, m: Column) -> Column:
    """Name of a segment from its mean scores, first rule that fits."""
    rules = [
        ((r >= 4) & (f >= 4) & (m >= 4), "VIP Champions"),
        ((r >= 3) & (f >= 4) & (m >= 3), "Loyal Customers"),
        ((r >= 4) & (f < 3) & (m >= 4), "Big Spenders"),
        ((r >= 4) & (f >= 3) & (m < 3), "Potential Loyalists"),
        ((r < 3) & (f >= 4) & (m >= 3), "At Risk Loyal"),
        ((r < 3) & (f < 3) & (m >= 4), "Cannot Lose Them"),
        ((r >= 3) & (f < 3) & (m < 3), "New Customers"),
        ((r < 3) & (f < 3) & (m < 3), "Lost Customers"),
    ]
    out = F.when(*rules[0])
    for cond, name in rules[1:]:
        out = out.when(cond, name)
    return out.otherwise("Regular Customers")


def strategy(churn: Column, r: Column, f: Column, m: Column) -> Column:
    return (
        F.when(churn > 0.5, "retention_focused")
        .when(m >= 4, "premium_experience")
        .when(f >= 4, "loyalty_rewards")
        .when(r >= 4, "cross_sell_upsell")
        .otherwise("reactivation_campaign")
    )


def name_segments(scored: DataFrame, segment: str, churn_days: int = 30) -> DataFrame:
    """One row per segment: size, mean scores, churn share, name, strategy, total value."""
    g = scored.groupBy(segment).agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("recency_score").alias("r"),
        F.avg("frequency_score").alias("f"),
        F.avg("monetary_score").alias("m"),
        ratio(F.count_if(F.col("recency_days") > churn_days), F.count(F.lit(1))).alias("churn_share"),
        F.sum("monetary_value").alias("lifetime_value"),
    )
    r, f, m = F.col("r"), F.col("f"), F.col("m")
    return g.withColumns({"name": segment_name(r, f, m), "strategy": strategy(F.col("churn_share"), r, f, m)})


def segment_overview(named: DataFrame) -> DataFrame:
    """Customer-weighted churn and value over all segments."""
    n = F.col("customers")
    return named.agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum(n).alias("customers"),
        ratio(F.sum(F.col("churn_share") * n), F.sum(n)).alias("weighted_churn"),
        F.sum("lifetime_value").alias("lifetime_value"),
    )


def seasonal_patterns(sales: DataFrame, min_rows: int = 10, min_cv: float = 0.3, unit_price: float = 25.0) -> DataFrame:
    """Categories whose monthly means vary by more than ``min_cv`` of their mean."""
    month = sales.groupBy("first_category", F.month("sale_date").alias("_m")).agg(
        F.count(F.lit(1)).alias("_n"), mean_of("units_sold").alias("_a"), (F.sum("units_sold") * unit_price).alias("_r")
    ).filter(F.col("_n") >= min_rows)
    g = month.groupBy("first_category").agg(
        F.avg("_a").alias("_o"),
        F.stddev_samp("_a").alias("_s"),
        ratio(F.max("_a"), F.min("_a")).alias("peak_to_low"),
        F.sum("_r").alias("annual_revenue"),
    )
    out = g.withColumn("variation", ratio("_s", "_o")).filter(F.col("_s") > F.col("_o") * min_cv)
    return out.select("first_category", "variation", "peak_to_low", "annual_revenue")


def promotion_response(sales: DataFrame, min_rows: int = 10, min_lift: float = 1.2, unit_price: float = 25.0) -> DataFrame:
    """Lift of promoted over regular units per category; both kinds need ``min_rows`` rows."""
    p = F.col("discount") > 0
    g = sales.groupBy("first_category").agg(
        F.count_if(p).alias("_np"),
        F.count_if(~p).alias("_nr"),
        mean_if(p, "units_sold").alias("promo_avg"),
        mean_if(~p, "units_sold").alias("regular_avg"),
        (sum_if(p, "units_sold") * unit_price).alias("promo_revenue"),
        (F.sum("units_sold") * unit_price).alias("category_revenue"),
    ).filter((F.col("_np") >= min_rows) & (F.col("_nr") >= min_rows))
    return g.withColumn("lift", ratio("promo_avg", "regular_avg")).filter(F.col("lift") > min_lift).drop("_np", "_nr")


def weekday_profile(sales: DataFrame) -> DataFrame:
    """Mean by weekday against the mean of the seven means."""
    g = sales.groupBy(F.weekday("sale_date").alias("day_of_week")).agg(
        mean_of("units_sold").alias("avg_sales"), F.count(F.lit(1)).alias("transactions"), F.sum("units_sold").alias("total_units")
    )
    mean = g.agg(F.avg("avg_sales")).scalar()
    return g.withColumn("relative_performance", ratio("avg_sales", mean))


def lifecycle(activity: DataFrame, as_of: dt.date, min_purchases: int = 3) -> DataFrame:
    """Active, at-risk and churned customers with rates; ``activity`` has customer_id, day, value."""
    per = activity.groupBy("customer_id").agg(
        F.date_diff(F.lit(as_of), F.max("day")).alias("_d"), F.sum("value").alias("_v"), F.count(F.lit(1)).alias("_n")
    ).filter(F.col("_n") >= min_purchases)
    d, n = F.col("_d"), F.count(F.lit(1))
    return per.agg(
        n.alias("total_customers"),
        F.count_if(d <= 7).alias("active"),
        F.count_if(d.between(8, 30)).alias("at_risk"),
        F.count_if(d > 30).alias("churned"),
        F.avg("_v").alias("avg_value"),
        F.avg("_n").alias("avg_frequency"),
        ratio(F.count_if(d > 30), n).alias("churn_rate"),
        ratio(F.count_if(d <= 30), n).alias("retention_rate"),
    )


def preferences(sales: DataFrame, product: DataFrame, min_rows: int = 10, unit_price: float = 25.0) -> DataFrame:
    """Products, revenue and units of each category, over products with at least ``min_rows`` sales."""
    g = sales.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("units_sold").alias("_u"),
        (F.sum("units_sold") * unit_price).alias("_r"),
        mean_of("units_sold").alias("_a"),
    ).filter(F.col("_n") >= min_rows)
    return g.join(product.select("product_id", "first_category"), "product_id").groupBy("first_category").agg(
        F.count(F.lit(1)).alias("products"),
        F.sum("_r").alias("revenue"),
        F.avg("_a").alias("avg_sales"),
        F.sum("_u").alias("total_units"),
    )
