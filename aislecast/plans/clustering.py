"""Clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as clu
from ..operators import correlation as cor
from ..operators import customers as cus
from ..operators import features
from ..operators.forecast import cached
from ..session import written
from .market import scored
from .registry import query

RFM = ["recency_score", "frequency_score", "monetary_score", "category_diversity", "store_loyalty", "spending_std"]
VECTOR = ["total_amount", "mean_amount", "active_days", "demand_cv", "stockout_rate", "temp_corr", "humidity_corr", "rain_corr", "discount_response", "mean_discount"]
STORE = [
    "total_sales", "mean_sales", "std_sales", "max_sales", "transactions", "total_units", "mean_units", "std_units", "mean_discount", "mean_price",
    "std_price", "mean_stock_hours", "stockout_rate", "holiday_share", "promo_share", "products", "subcategories", "consistency", "turnover",
    "weekend_ratio", "promo_uplift", "holiday_boost", "temp_corr", "humidity_corr", "rain_corr", "seasonal_variation", "city_market_share",
]


def _vector(t, entity):
    return clu.held_once(features.entity_vector(t.sales(category=False), entity))


@query("customer_clusters", "CLU-1 CUS-2 CMB-10")
def customer_clusters(t):
    clustered = clu.kmeans_clusters(clu.held_once(scored(t)), RFM, 5)
    return cus.name_segments(clustered, "cluster")


@query("store_clusters", "CLU-1 CLU-3 FEA-15 CMB-9")
def store_clusters(t):
    v = clu.held_once(features.store_vector(t.sales(), t.with_hours(t.lines())))
    columns = clu.select_features(v, STORE)
    return clu.kmeans_clusters(v, columns, 4, components=20).select("store_id", "city_id", "total_sales", "cluster", "distance")


@query("product_clusters", "CLU-1 CLU-7")
def product_clusters(t):
    return clu.similarity(clu.kmeans_clusters(_vector(t, "product_id"), VECTOR, 5), "product_id")


@query("city_clusters", "CLU-1 FEA-14")
def city_clusters(t):
    return clu.kmeans_clusters(_vector(t, "city_id"), VECTOR, 3).select("city_id", "cluster", "distance")


@query("cluster_count_choice", "CLU-2 CMB-8")
def cluster_count_choice(t):
    return clu.choose_k(_vector(t, "store_id"), VECTOR, range(2, 11))


@query("density_clusters", "CLU-4")
def density_clusters(t):
    return clu.density_clusters(_vector(t, "product_id"), "product_id", ["total_amount", "mean_amount", "active_days", "stockout_rate"])


@query("cluster_quality", "CLU-5")
def cluster_quality(t):
    clustered = clu.kmeans_clusters(_vector(t, "store_id"), VECTOR, 4)
    return clu.cluster_quality(clustered, VECTOR)


@query("cluster_sizes", "CLU-5 CLU-6")
def cluster_sizes(t):
    return clu.cluster_sizes(clu.kmeans_clusters(_vector(t, "store_id"), VECTOR, 4))


@query("cluster_profiles", "CLU-6 SRT-3")
def cluster_profiles(t):
    return clu.cluster_profiles(clu.kmeans_clusters(_vector(t, "product_id"), VECTOR, 5), VECTOR).filter(F.col("place") <= 10)


@query("cluster_insights", "CLU-7 CLU-9")
def cluster_insights(t):
    profiles = clu.cluster_profiles(clu.kmeans_clusters(_vector(t, "product_id"), VECTOR, 5), VECTOR)
    return clu.cluster_insights(clu.cluster_names(profiles, "total_amount"))


@query("cluster_representatives", "CLU-7")
def cluster_representatives(t):
    return clu.representatives(clu.kmeans_clusters(_vector(t, "product_id"), VECTOR, 5), "product_id", 5)


@query("cluster_assignment", "CLU-7")
def cluster_assignment(t):
    v = clu.held_once(features.entity_vector(t.sales(category=False, since=t.day(180)), "product_id"))
    return clu.with_unseen(t.product, clu.kmeans_clusters(v, VECTOR, 5), "product_id")


@query("weather_sensitivity_clusters", "CLU-8 COR-6")
def weather_sensitivity_clusters(t):
    s = t.sales(category=False)
    long = cor.factor_correlations(s, "product_id")
    names = ["temperature", "humidity", "precipitation", "wind", "comfort"]
    # held as the fit deals its rows, on which the starting centres depend
    with cached(long.groupBy("product_id").pivot("factor", names).agg(F.max("r"))) as wide:
        n = wide.count()
        return written(clu.kmeans_clusters(wide, names, min(5, max(2, n // 2))).select("product_id", "cluster", "distance"))


@query("dominant_city_clusters", "CMB-9")
def dominant_city_clusters(t):
    return clu.dominant_clusters(store_clusters(t), "city_id")


@query("cluster_performance_bands", "CMB-9")
def cluster_performance_bands(t):
    return clu.performance_bands(store_clusters(t), "total_sales")


@query("main_components", "CLU-3")
def main_components(t):
    return clu.principal_components(_vector(t, "product_id"), "product_id", VECTOR, 4)
