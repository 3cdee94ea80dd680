"""Store comparison, metrics, segments, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import is_weekend
from ..functions.core import mean_if, mean_of, ratio, share_if, std_of
from .ranking import column_quantiles, exact_quantiles, with_global_rank, with_group_ranks, with_percent_rank


def compare_stores(sales: DataFrame, store: DataFrame) -> DataFrame:
    """Revenue, reliability and ranks per store; the fact is aggregated before it meets the dimension."""
    metrics = sales.groupBy("store_id").agg(
        F.count_distinct("product_id").alias("active_products"),
        F.sum("sale_amount").alias("total_revenue"),
        mean_of("sale_amount").alias("avg_daily_revenue"),
        F.sum("stock_hour6_22_cnt").alias("total_stockout_hours"),
        share_if(F.col("stock_hour6_22_cnt") > 0).alias("stockout_frequency"),
        F.count(F.lit(1)).alias("days_of_data"),
    )
    named = metrics.join(store.select("store_id", "store_name", "city_id", "city_name"), "store_id")
    ranked = with_group_ranks(named, ["city_id"], {"city_revenue_rank": ("total_revenue", "desc"), "city_reliability_rank": ("stockout_frequency", "asc")})
    return with_global_rank(ranked, "total_revenue", "overall_revenue_rank")


def store_metrics(sales: DataFrame) -> DataFrame:
    """Totals, diversity, promotion, holiday and weekend ratios, consistency per store."""
    mean = mean_of("sale_amount")
    weekend = is_weekend(F.col("sale_date"))
    return sales.groupBy("store_id").agg(
        F.sum("sale_amount").alias("total_sales"),
        mean.alias("avg_daily_sales"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.count_distinct("product_id").alias("product_diversity"),
        F.coalesce(ratio(mean_if(F.col("activity_flag"), "sale_amount"), mean), F.lit(1.0)).alias("promo_effectiveness"),
        F.coalesce(ratio(mean_if(F.col("holiday_flag"), "sale_amount"), mean), F.lit(1.0)).alias("holiday_uplift"),
        F.coalesce(1 / (1 + ratio(std_of("sale_amount"), mean)), F.lit(0.0)).alias("consistency_score"),
        F.coalesce(ratio(mean_if(weekend, "sale_amount"), mean_if(~weekend, "sale_amount")), F.lit(1.0)).alias(
            "weekend_performance"
        ),
    )


def daily_store_metrics(sales: DataFrame) -> DataFrame:
    """One row per store and day with its place that day."""
    g = sales.groupBy("store_id", "sale_date").agg(
        F.sum("sale_amount").alias("total_sales"),
        F.sum("units_sold").alias("total_units"),
        F.count_distinct("product_id").alias("products_sold"),
        F.sum("stock_hour6_22_cnt").alias("stockout_hours"),
    )
    return with_group_ranks(g, ["sale_date"], {"performance_rank": ("total_sales", "desc")})


def _cuts(metrics: DataFrame) -> DataFrame:
    cuts = column_quantiles(
        metrics,
        {
            "avg_daily_sales": {"q25": 0.25, "q50": 0.5, "q75": 0.75},
            "promo_effectiveness": {"p60": 0.6},
            "consistency_score": {"c60": 0.6},
        },
    )
    return metrics.withColumn("_s", cuts.select(F.struct(*cuts.columns)).scalar())


def store_segments(metrics: DataFrame) -> DataFrame:
    """Rule segments, which may overlap: high performers, growing, stable, improvement needed."""
    m = _cuts(metrics)
    a, p, c = F.col("avg_daily_sales"), F.col("promo_effectiveness"), F.col("consistency_score")
    names = F.array_compact(
        F.array(
            F.when(a >= F.col("_s.q75"), "A"),
            F.when((a >= F.col("_s.q50")) & (p >= F.col("_s.p60")), "B"),
            F.when((a >= F.col("_s.q50")) & (c >= F.col("_s.c60")), "C"),
            F.when(a <= F.col("_s.q25"), "D"),
        )
    )
    rows = m.withColumn("segment", F.explode(names))
    return rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("stores"),
        F.avg("avg_daily_sales").alias("avg_sales"),
        F.avg("promo_effectiveness").alias("avg_promo_effectiveness"),
        F.avg("consistency_score").alias("avg_consistency"),
    )


def assign_segment(metrics: DataFrame) -> DataFrame:
    """One segment per store by level, promotion response and consistency."""
    q = exact_quantiles(metrics, "avg_daily_sales", {"q50": 0.5, "q75": 0.75}).select(F.struct("q50", "q75")).scalar()
    a = F.col("avg_daily_sales")
    m = metrics.withColumn("_s", q)
    seg = (
        F.when(a >= F.col("_s.q75"), "A")
        .when((a >= F.col("_s.q50")) & (F.col("promo_effectiveness") > 1.2), "B")
        .when((a >= F.col("_s.q50")) & (F.col("consistency_score") > 0.7), "C")
        .otherwise("D")
    )
    return m.withColumn("segment", seg).drop("_s")


def store_profile(metrics: DataFrame) -> DataFrame:
    """Characteristics on 0..100 against all stores, and percentile rank of the level."""
    ext = metrics.agg(
        F.struct(
            F.min("avg_daily_sales").alias("a0"),
            F.max("avg_daily_sales").alias("a1"),
            F.min("promo_effectiveness").alias("p0"),
            F.max("promo_effectiveness").alias("p1"),
            F.max("product_diversity").alias("d1"),
            F.max("transaction_count").alias("t1"),
        )
    ).scalar()
    m = with_percent_rank(metrics, "avg_daily_sales", "percentile").withColumn("_e", ext)

    def minmax(c, low, high):
        return F.coalesce(ratio(F.col(c) - F.col(f"_e.{low}"), F.col(f"_e.{high}") - F.col(f"_e.{low}")) * 100, F.lit(50.0))

    return m.select(
        "store_id",
        minmax("avg_daily_sales", "a0", "a1").alias("sales_performance"),
        (F.col("consistency_score") * 100).alias("customer_loyalty"),
        F.least(
            ratio("product_diversity", F.col("_e.d1")) * 50 + ratio("transaction_count", F.col("_e.t1")) * 50, F.lit(100.0)
        ).alias("inventory_efficiency"),
        minmax("promo_effectiveness", "p0", "p1").alias("promotion_effectiveness"),
        (F.col("percentile") * 100).alias("percentile"),
    )


def cross_store_scores(metrics: DataFrame) -> DataFrame:
    """Performance score (40 level, 30 promotion, 30 consistency), efficiency score and place."""
    best = metrics.agg(F.max("avg_daily_sales")).scalar()
    scored = metrics.withColumns(
        {
            "performance_score": ratio("avg_daily_sales", best) * 40
            + F.col("promo_effectiveness") * 30
            + F.col("consistency_score") * 30,
            "efficiency_score": F.col("promo_effectiveness") * 60 + F.col("consistency_score") * 40,
        }
    ).select("store_id", "avg_daily_sales", "total_sales", "performance_score", "efficiency_score")
    return with_global_rank(scored, "performance_score", "ranking")


def cross_store_summary(scores: DataFrame) -> DataFrame:
    """Mean, gap and upper quartile of the performance scores, best and worst store."""
    p = F.struct(F.col("performance_score"), -F.col("store_id"))
    q = exact_quantiles(scores, "performance_score", {"v": 0.75}).select("v").scalar()
    return scores.agg(
        F.count(F.lit(1)).alias("stores"),
        F.avg("performance_score").alias("average_performance"),
        (F.max("performance_score") - F.min("performance_score")).alias("performance_gap"),
        (F.max("efficiency_score") - F.min("efficiency_score")).alias("efficiency_gap"),
        F.max_by("store_id", p).alias("best_store"),
        F.min_by("store_id", p).alias("worst_store"),
    ).withColumn("top_quartile", q)


def forecast_rankings(history: DataFrame, forecast: DataFrame, item: str) -> DataFrame:
    """Stores ranked within each item by forecast demand, reliability and growth; overall .4, .3, .3 (average ranks)."""
    h = history.groupBy("store_id", item).agg(
        mean_of("sale_amount").alias("avg_demand"),
        ratio(std_of("sale_amount"), mean_of("sale_amount")).alias("volatility"),
        (mean_of("stock_hours") / 16).alias("stockout_rate"),
    )
    f = forecast.groupBy("store_id", item).agg(F.sum("forecast").alias("predicted"))
    m = h.join(f, ["store_id", item]).withColumn("growth", ratio("predicted", "avg_demand") - 1)

    m = with_group_ranks(
        m, [item], {"demand_rank": ("predicted", "desc_average"), "reliability_rank": ("stockout_rate", "asc_average"), "growth_rank": ("growth", "desc_average")}
    )
    return m.withColumn(
        "overall_score", F.col("demand_rank") * 0.4 + F.col("reliability_rank") * 0.3 + F.col("growth_rank") * 0.3
    )


def best_practices(metrics: DataFrame, columns=("promo_effectiveness", "holiday_uplift", "consistency_score", "weekend_performance", "product_diversity")) -> DataFrame:
    """Top quarter of stores against the rest, measure by measure."""
    q = exact_quantiles(metrics, "avg_daily_sales", {"v": 0.75}).select("v").scalar()
    m = metrics.withColumn("_top", F.col("avg_daily_sales") >= q)
    long = m.select("_top", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["_top"], list(columns), "measure", "value")
    g = long.groupBy("measure").agg(
        F.avg(F.when(F.col("_top"), F.col("value"))).alias("top_mean"), F.avg(F.when(~F.col("_top"), F.col("value"))).alias("rest_mean")
    )
    return g.withColumn("gap_pct", ratio(F.col("top_mean") - F.col("rest_mean"), "rest_mean") * 100)
