"""Product and category portfolio: performance, stars, bundles, concentration."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import clamp, ladder, mean_if, mean_of, ratio, std_of
from .correlation import positive_correlations
from .ranking import with_global_rank


def product_performance(sales: DataFrame, min_rows: int = 7, unit_price: float = 25.0) -> DataFrame:
    """Revenue, consistency, share, ranks and star score of each product."""
    g = sales.filter(F.col("units_sold") > 0).groupBy("product_id").agg(
        F.count_distinct("store_id").alias("store_presence"),
        F.sum("units_sold").alias("total_units"),
        (F.sum("units_sold") * unit_price).alias("total_revenue"),
        mean_of("units_sold").alias("avg_daily_sales"),
        std_of("units_sold").alias("sales_stddev"),
        F.count(F.lit(1)).alias("days_active"),
        F.min("sale_date").alias("first_sale"),
        F.max("sale_date").alias("last_sale"),
    ).filter(F.col("days_active") >= min_rows)
    total = g.agg(F.sum("total_revenue")).scalar()
    best = g.agg(F.max("total_revenue")).scalar()
    out = g.withColumns(
        {
            "revenue_share": ratio("total_revenue", total),
            "consistency": 1 / (F.col("sales_stddev") + 1),
            "star_score": ratio("total_revenue", best) / (F.col("sales_stddev") + 1),
        }
    )
    return with_global_rank(with_global_rank(out, "total_revenue", "revenue_rank"), "avg_daily_sales", "sales_rank")


def performance_segments(perf: DataFrame, top: int = 10, stars: int = 5) -> DataFrame:
    """Best ten, weakest ten and five stars of all products (a report of at most 25 rows)."""
    cols = ["product_id", "total_revenue", "avg_daily_sales", "star_score"]

    def pick(label, *order, n):
        return perf.orderBy(*order).limit(n).select(F.lit(label).alias("segment"), *cols)

    return (
        pick("top", F.desc("total_revenue"), F.asc("product_id"), n=top)
        .unionByName(pick("under", F.asc("total_revenue"), F.desc("product_id"), n=top))
        .unionByName(pick("star", F.desc("star_score"), F.asc("product_id"), n=stars))
    )


def bundles(
    sales: DataFrame,
    recent: DataFrame,
    min_corr: float = 0.4,
    min_rows: int = 14,
    min_revenue: float = 1000.0,
    unit_price: float = 25.0,
) -> DataFrame:
    """Product pairs worth bundling: correlation over store-days, month revenue, success probability, discount."""
    pairs = positive_correlations(sales, "product_id", ["sale_date", "store_id"], "units_sold", min_corr)
    day = recent.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("_n"), (mean_of("units_sold") * unit_price).alias("_rev"), F.count_distinct("store_id").alias("_st")
    ).filter(F.col("_n") >= min_rows)
    a = day.select(F.col("product_id").alias("item_a"), F.col("_rev").alias("_ra"), F.col("_st").alias("_sa"))
    b = day.select(F.col("product_id").alias("item_b"), F.col("_rev").alias("_rb"), F.col("_st").alias("_sb"))
    r = F.col("r")
    return (
        pairs.join(a, "item_a")
        .join(b, "item_b")
        .withColumn("revenue_potential", (F.col("_ra") + F.col("_rb")) * 30)
        .filter(F.col("revenue_potential") >= min_revenue)
        .select(
            "item_a",
            "item_b",
            "r",
            F.col("_ra").alias("revenue_a"),
            F.col("_rb").alias("revenue_b"),
            "revenue_potential",
            F.least(F.lit(0.95), (r + 0.5) * 0.8).alias("success_probability"),
            clamp((1 - r) * 30, 5, 20).alias("discount"),
            F.least("_sa", "_sb").alias("stores"),
        )
    )


def bundle_triples(pairs: DataFrame, min_corr: float = 0.7, min_revenue: float = 1500.0) -> DataFrame:
    """Sets of three from two bundles of at least ``min_corr`` that share exactly one product."""
    best = pairs.filter(F.col("r") >= min_corr)
    ends = best.select(F.col("item_a").alias("hub"), F.col("item_b").alias("leaf"), "r", F.col("revenue_a").alias("hr"), F.col("revenue_b").alias("lr"))
    ends = ends.unionByName(
        best.select(F.col("item_b").alias("hub"), F.col("item_a").alias("leaf"), "r", F.col("revenue_b").alias("hr"), F.col("revenue_a").alias("lr"))
    )
    x = ends.select("hub", "hr", F.col("leaf").alias("leaf_a"), F.col("r").alias("_ra"), F.col("lr").alias("_la"))
    y = ends.select("hub", F.col("leaf").alias("leaf_b"), F.col("r").alias("_rb"), F.col("lr").alias("_lb"))
    t = x.join(y, "hub").filter(F.col("leaf_a") < F.col("leaf_b"))
    avg = (F.col("_ra") + F.col("_rb")) / 2
    return t.select(
        "hub",
        "leaf_a",
        "leaf_b",
        avg.alias("r"),
        F.least(F.lit(0.9), avg * 0.7).alias("success_probability"),
        ((F.col("hr") + F.col("_la") + F.col("_lb")) * 30).alias("revenue_potential"),
    ).filter(F.col("revenue_potential") >= min_revenue)


def category_portfolio(sales: DataFrame, as_of: dt.date, min_rows: int = 30, unit_price: float = 25.0) -> DataFrame:
    """Share, growth (30 days against 31 to 90), profitability, strength and recommendation per category."""
    d, u = F.col("sale_date"), F.col("units_sold")
    new = d >= F.lit(as_of - dt.timedelta(days=30))
    old = d.between(F.lit(as_of - dt.timedelta(days=90)), F.lit(as_of - dt.timedelta(days=30)))
    g = sales.groupBy("first_category").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_distinct("product_id").alias("total_products"),
        F.sum(u).alias("total_units"),
        (F.sum(u) * unit_price).alias("total_revenue"),
        std_of(u).alias("_sd"),
        mean_if(new, u).alias("_new"),
        mean_if(old, u).alias("_old"),
    ).filter(F.col("_n") >= min_rows)
    total = g.agg(F.sum("total_revenue")).scalar()
    growth = F.coalesce(F.when(F.col("_old") > 0, (F.col("_new") - F.col("_old")) / F.col("_old")).otherwise(0.0), F.lit(0.0))
    g = g.withColumns({"market_share": ratio("total_revenue", total), "growth_rate": growth})
    stable = 100 - F.least(F.lit(50.0), F.coalesce("_sd", F.lit(0.0)) * 10)
    volume = F.least(F.lit(50.0), F.col("total_units") / 100)
    share, gr = F.col("market_share"), F.col("growth_rate")
    return g.withColumns(
        {
            "profitability": (stable + volume) / 2,
            "strength": ladder(
                "market_share", [(0.15, "market_leader"), (0.10, "strong_player"), (0.05, "moderate_player")], "niche_player", op=">"
            ),
            "recommendation": F.when((gr > 0.1) & (share > 0.1), "invest_and_expand")
            .when(gr > 0.05, "maintain_and_grow")
            .when(gr < -0.1, "evaluate_and_optimize")
            .otherwise("monitor_closely"),
        }
    ).drop("_n", "_sd", "_new", "_old")


def portfolio_overview(perf: DataFrame) -> DataFrame:
    """Products, revenue, concentration index and its class."""
    share = F.col("revenue_share")
    g = perf.agg(
        F.count(F.lit(1)).alias("products"),
        F.sum("total_revenue").alias("total_revenue"),
        (F.sum(share * share) * 10000).alias("concentration_index"),
        F.max(share).alias("largest_share"),
        F.avg("avg_daily_sales").alias("mean_daily_sales"),
    )
    return g.withColumn("concentration", ladder("concentration_index", [(2500, "high"), (1500, "moderate")], "low"))
