"""Alert monitors over recent windows; every monitor yields the same columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import ladder, mean_if, mean_of, safe_corr, std_of, sum_if
from .series import moving_baseline

SEVERITIES = ("critical", "high", "medium", "low")


def _alert(df: DataFrame, kind, severity: Column, store, item, value: Column, impact: Column, urgency: Column, revenue: Column):
    return df.select(
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("alert_type"),
        severity.alias("severity"),
        F.col(store).cast("bigint").alias("store_id"),
        (F.col(item).cast("string") if item else F.lit(None).cast("string")).alias("item"),
        value.cast("double").alias("current_value"),
        F.least(F.lit(100.0), impact.cast("double")).alias("impact_score"),
        urgency.cast("int").alias("urgency_level"),
        revenue.cast("double").alias("revenue_impact"),
    )


def low_stock(
    sales: DataFrame, item: str = "product_id", min_rows: int = 7, threshold: float = 5.0, unit_price: float = 25.0
) -> DataFrame:
    """Cover of at most ``threshold`` days."""
    g = sales.groupBy("store_id", item).agg(
        mean_of("units_sold").alias("_avg"), F.max("stock_level").alias("_stock"), F.count(F.lit(1)).alias("_n")
    ).filter((F.col("_n") >= min_rows) & (F.col("_stock") > 0) & (F.col("_avg") > 0))
    days = F.col("_stock") / F.greatest(F.col("_avg"), F.lit(1.0))
    g = g.withColumn("_days", days).filter(F.col("_days") <= threshold)
    return _alert(
        g,
        "stockout",
        ladder("_days", [(1, "critical"), (2, "high"), (3, "medium")], "low", op="<="),
        "store_id",
        item,
        F.col("_days"),
        (6 - F.col("_days")) * 20,
        F.when(F.col("_days") <= 2, 5).otherwise(4),
        F.col("_avg") * 10 * unit_price,
    )


def demand_anomalies(
    daily: DataFrame, since: dt.date, item: str = "product_id", threshold: float = 2.0, unit_price: float = 25.0
) -> DataFrame:
    """Recent rows whose z-score against the moving baseline reaches the threshold (filtered after the window)."""
    z = moving_baseline(daily, ["store_id", item], "units_sold").filter(
        (F.col("sale_date") >= F.lit(since)) & (F.col("baseline_std") > 0) & (F.abs("z_score") >= threshold)
    )
    z = z.withColumn("_a", F.abs("z_score"))
    return _alert(
        z,
        F.when(F.col("z_score") > 0, "demand_spike").otherwise("anomaly_detection"),
        ladder("_a", [(4, "critical"), (3, "high"), (2.5, "medium")], "low"),
        "store_id",
        item,
        F.col("_a"),
        F.col("_a") * 25,
        F.least(F.lit(5), F.floor("_a")),
        F.abs(F.col("units_sold") - F.col("baseline_mean")) * unit_price,
    )


def weather_impacts(
    sales: DataFrame, recent: DataFrame, item: str, min_rows: int = 30, min_corr: float = 0.3, min_z: float = 2.0, unit_price: float = 25.0
) -> DataFrame:
    """Weather-sensitive series whose current temperature is unusual for them."""
    g = sales.groupBy("store_id", item).agg(
        F.count(F.lit(1)).alias("_n"),
        safe_corr("units_sold", "avg_temperature").alias("_ct"),
        safe_corr("units_sold", "avg_humidity").alias("_ch"),
        safe_corr("units_sold", "precpt").alias("_cp"),
        mean_of("units_sold").alias("_avg"),
        F.avg("avg_temperature").alias("_t"),
        std_of("avg_temperature").alias("_s"),
    ).filter(F.col("_n") >= min_rows)
    g = g.filter((F.abs("_ct") >= min_corr) | (F.abs("_ch") >= min_corr) | (F.abs("_cp") >= min_corr)).filter(F.col("_s") > 0)
    now = recent.select("store_id", item, "sale_date", F.col("avg_temperature").alias("_now")).distinct()
    hit = g.join(now, ["store_id", item]).withColumn("_z", F.abs((F.col("_now") - F.col("_t")) / F.col("_s")))
    hit = hit.filter(F.col("_z") >= min_z)
    change = F.abs("_ct") * F.col("_z") * F.col("_avg") * 0.2
    return _alert(
        hit,
        "weather_impact",
        F.when(F.col("_z") >= 3, "medium").otherwise("low"),
        "store_id",
        item,
        F.col("_z"),
        F.abs("_ct") * 100,
        F.when(F.col("_z") >= 3, 3).otherwise(2),
        change * unit_price,
    )


def promotion_opportunities(
    sales: DataFrame,
    item: str,
    min_rows: int = 30,
    cover: float = 10.0,
    min_promo_days: int = 5,
    min_lift: float = 1.2,
    min_days: float = 14.0,
    unit_price: float = 25.0,
) -> DataFrame:
    """Well-stocked series that have answered promotions."""
    disc = F.col("discount") > 0
    g = sales.groupBy("store_id", item).agg(
        F.count(F.lit(1)).alias("_n"),
        mean_of("units_sold").alias("_avg"),
        F.max("stock_level").alias("_stock"),
        mean_if(disc, "units_sold").alias("_p"),
        mean_if(~disc, "units_sold").alias("_r"),
        F.count_if(disc).alias("_pd"),
    ).filter((F.col("_n") >= min_rows) & (F.col("_stock") > F.col("_avg") * cover) & (F.col("_pd") >= min_promo_days))
    g = g.withColumn("_lift", F.when(F.col("_p").isNotNull() & (F.col("_r") > 0), F.col("_p") / F.col("_r")).otherwise(1.0))
    g = g.withColumn("_days", F.col("_stock") / F.greatest(F.col("_avg"), F.lit(1.0)))
    g = g.filter((F.col("_lift") >= min_lift) & (F.col("_days") > min_days))
    return _alert(
        g,
        "promotion_opportunity",
        F.lit("medium"),
        "store_id",
        item,
        F.col("_days"),
        (F.col("_lift") - 1) * 100,
        F.lit(2),
        (F.col("_lift") - 1) * F.col("_avg") * 7 * unit_price,
    )


def store_declines(
    sales: DataFrame, as_of: dt.date, recent: int = 7, span: int = 28, min_rows: int = 20, threshold: float = 0.15, unit_price: float = 25.0
) -> DataFrame:
    """Stores whose recent mean fell against the weeks before."""
    d, u = F.col("sale_date"), F.col("units_sold")
    new = d >= F.lit(as_of - dt.timedelta(days=recent))
    old = d.between(F.lit(as_of - dt.timedelta(days=span)), F.lit(as_of - dt.timedelta(days=recent)))
    g = sales.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("_n"),
        mean_if(new, u).alias("_ra"),
        mean_if(old, u).alias("_ba"),
        (sum_if(new, u) * unit_price).alias("_rr"),
        (sum_if(old, u) * unit_price).alias("_br"),
    ).filter((F.col("_n") >= min_rows) & (F.col("_ba") > 0))
    g = g.withColumn("_chg", (F.col("_ra") - F.col("_ba")) / F.col("_ba")).filter(F.col("_chg") <= -threshold)
    g = g.withColumn("_a", F.abs("_chg"))
    return _alert(
        g,
        "performance_decline",
        ladder("_a", [(0.30, "critical"), (0.20, "high"), (0.15, "medium")], "low"),
        "store_id",
        None,
        F.col("_a"),
        F.col("_a") * 200,
        F.when(F.col("_a") >= 0.25, 4).otherwise(3),
        F.coalesce(F.col("_br") - F.col("_rr"), F.lit(0.0)),
    )


def merge_alerts(alerts: Sequence[DataFrame], top: int | None = 50) -> DataFrame:
    """All monitors, one alert per (store, item, type) by impact and urgency, most important first."""
    out = alerts[0]
    for a in alerts[1:]:
        out = out.unionByName(a)
    w = W.partitionBy("store_id", "item", "alert_type").orderBy(F.desc("impact_score"), F.desc("urgency_level"), F.desc("current_value"))
    out = out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
    if top is None:
        return out
    return out.orderBy(
        F.desc("impact_score"), F.desc("urgency_level"), "alert_type", "store_id", F.asc_nulls_first("item")
    ).limit(top)


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Count, mean impact and revenue by type and severity."""
    return alerts.groupBy("alert_type", "severity").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.avg("impact_score").alias("avg_impact"),
        F.sum("revenue_impact").alias("total_revenue_impact"),
    )


def alert_dashboard(log: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Stored alerts of the last days: count, impact, acknowledged, resolved, mean response hours, latest."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    hours = (F.unix_seconds(F.col("acknowledged_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))) / 3600
    return (
        log.filter(F.col("created_at") >= since)
        .groupBy("alert_type", "severity")
        .agg(
            F.count(F.lit(1)).alias("alert_count"),
            F.avg("impact_score").alias("avg_impact"),
            F.count_if("is_acknowledged").alias("acknowledged"),
            F.count_if(F.col("resolution_status") == "resolved").alias("resolved"),
            F.avg(hours).alias("avg_response_hours"),
            F.max("created_at").alias("latest_alert"),
        )
    )


