"""Category performance, seasonality, market position and assortment advice."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import ladder, mean_if, mean_of, ratio, std_of, sum_if
from ..session import ensure_checkpoint_dir
from .ranking import column_quantiles, with_global_rank


def category_performance(daily: DataFrame, edge: int = 30) -> DataFrame:
    """Total, mean, variation, growth (last against first rows), share and promotion uplift from daily category sales."""
    w = W.partitionBy("first_category")
    ranked = daily.withColumns(
        {"_up": F.row_number().over(w.orderBy("sale_date")), "_down": F.row_number().over(w.orderBy(F.desc("sale_date")))}
    )
    a, promo = F.col("sale_amount"), F.col("activity_flag")
    g = ranked.groupBy("first_category").agg(
        F.sum(a).alias("total_sales"),
        mean_of(a).alias("avg_daily_sales"),
        ratio(std_of(a), mean_of(a)).alias("volatility"),
        F.count(F.lit(1)).alias("data_points"),
        mean_if(F.col("_up") <= edge, a).alias("_f"),
        mean_if(F.col("_down") <= edge, a).alias("_l"),
        mean_if(promo, a).alias("_p"),
        mean_if(~promo, a).alias("_r"),
    )
    total = g.agg(F.sum("total_sales").cast("double")).scalar()
    growth = F.when(F.col("data_points") > edge, ratio(F.col("_l") - F.col("_f"), "_f") * 100).otherwise(0.0)
    return g.withColumns(
        {
            "growth_pct": F.coalesce(growth, F.lit(0.0)),
            "share_pct": ratio("total_sales", total) * 100,
            "promo_uplift_pct": ratio(F.col("_p") - F.col("_r"), "_r") * 100,
        }
    ).drop("_f", "_l", "_p", "_r")


def monthly_index(sales: DataFrame) -> DataFrame:
    """Month 1..12 with sales indexed to the first month that has any; gaps repeat the month before."""
    m = sales.groupBy(F.month("sale_date").alias("month")).agg(F.sum("sale_amount").cast("double").alias("_v"))
    base = m.agg(F.min_by("_v", "month")).scalar()
    months = sales.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    filled = months.join(m.withColumn("_i", ratio("_v", base) * 100), "month", "left")
    w = W.partitionBy(F.lit(0)).orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return filled.select("month", F.coalesce(F.last("_i", ignorenulls=True).over(w), F.lit(100.0)).alias("sales_index"))


def seasonality_pattern(sales: DataFrame, keys: tuple[str, ...] = ("first_category",)) -> DataFrame:
    """Peak and low month, their relative gap and the pattern it stands for."""
    m = sales.groupBy(*keys, F.month("sale_date").alias("_m")).agg(mean_of("sale_amount").alias("_a"))
    g = m.groupBy(*keys).agg(
        F.max_by("_m", F.struct("_a", -F.col("_m"))).alias("peak_month"),
        F.min_by("_m", F.struct("_a", "_m")).alias("low_month"),
        ratio(F.max("_a") - F.min("_a"), F.min("_a")).alias("strength"),
    )
    pm = F.col("peak_month")
    return g.withColumn(
        "pattern",
        F.when(F.col("strength") <= 0.3, "stable_year_round")
        .when(pm.isin(11, 12, 1), "holiday_driven")
        .when(pm.isin(6, 7, 8), "summer_peak")
        .when(pm.isin(3, 4, 5), "spring_driven")
        .otherwise("irregular"),
    )


def market_position(sales: DataFrame, as_of: dt.date) -> DataFrame:
    """Share, growth of the last 90 days on the 90 before, and position of every category."""
    d, a = F.col("sale_date"), F.col("sale_amount")
    new = d >= F.lit(as_of - dt.timedelta(days=90))
    old = (d >= F.lit(as_of - dt.timedelta(days=180))) & (d < F.lit(as_of - dt.timedelta(days=90)))
    g = sales.groupBy("first_category").agg(
        F.sum(a).alias("total_sales"),
        F.coalesce(ratio(sum_if(new, a) - sum_if(old, a), sum_if(old, a)) * 100, F.lit(0.0)).alias("growth_pct"),
    )
    total = g.agg(F.sum("total_sales").cast("double")).scalar()
    g = g.withColumn("share_pct", ratio("total_sales", total) * 100)
    return g.withColumn("position", ladder("share_pct", [(30, "Dominant"), (20, "Strong"), (10, "Moderate")], "Weak", op=">"))


def assortment_advice(sales: DataFrame) -> DataFrame:
    """Products flagged as additions (good mean, few sales) and removals (lowest totals and means), with the fifth on top."""
    ensure_checkpoint_dir(sales.sparkSession)
    g = sales.groupBy("product_id").agg(
        F.sum("sale_amount").cast("double").alias("total_sales"),
        mean_of("sale_amount").alias("avg_sales"),
        F.count(F.lit(1)).alias("transactions"),
    ).checkpoint()
    cuts = column_quantiles(
        g, {"avg_sales": {"avg_med": 0.5, "avg_q20": 0.2}, "transactions": {"n_med": 0.5}, "total_sales": {"tot_q10": 0.1}}
    )
    n = g.agg(F.count(F.lit(1))).scalar()
    ranked = with_global_rank(g, "total_sales", "sales_rank").withColumns(
        {"_q": cuts.select(F.struct(*cuts.columns)).scalar(), "_cnt": n}
    )
    return ranked.select(
        "product_id",
        "total_sales",
        "avg_sales",
        "transactions",
        (F.col("sales_rank") <= F.floor(F.col("_cnt") * 0.2)).alias("is_top_fifth"),
        ((F.col("avg_sales") > F.col("_q.avg_med")) & (F.col("transactions") < F.col("_q.n_med"))).alias("is_addition"),
        ((F.col("total_sales") < F.col("_q.tot_q10")) & (F.col("avg_sales") < F.col("_q.avg_q20"))).alias("is_removal"),
    )


def assortment_efficiency(advice: DataFrame) -> DataFrame:
    top = F.sum(F.when(F.col("is_top_fifth"), F.col("total_sales")))
    return advice.agg(
        F.count(F.lit(1)).alias("products"),
        (ratio(top, F.sum("total_sales")) * 100).alias("efficiency_pct"),
        F.count_if("is_addition").alias("additions"),
        F.count_if("is_removal").alias("removals"),
        (F.coalesce(F.sum(F.when(F.col("is_addition"), F.col("total_sales"))), F.lit(0.0)) * 1.5).alias("revenue_potential"),
    )


def phase_indexes(daily: DataFrame) -> DataFrame:
    """Monthly and weekly index of each category: mean of the phase over the overall mean."""
    a = F.col("sale_amount")
    overall = daily.groupBy("first_category").agg(mean_of(a).alias("_o"))

    def by(kind, phase):
        g = daily.groupBy("first_category", phase.alias("phase")).agg(mean_of(a).alias("_m"))
        return g.join(overall, "first_category").select(
            "first_category", F.lit(kind).alias("kind"), "phase", ratio("_m", "_o").alias("index")
        )

    return by("month", F.month("sale_date")).unionByName(by("weekday", F.weekday("sale_date")))


def decompose(dense: DataFrame, keys: tuple[str, ...] = ("first_category",), period: int = 7, value: str = "sale_amount") -> DataFrame:
    """Additive decomposition of gap-free daily series: centred moving average, phase means summing to 0, residual.

    An even period uses the usual half weights at both ends.  Trend is NULL where the frame is not full.
    """
    w = W.partitionBy(*keys).orderBy("sale_date")
    half, x = period // 2, F.col(value).cast("double")
    frame = w.rowsBetween(-half, half)
    if period % 2:
        centred = F.sum(x).over(frame) / period
    else:
        centred = (F.sum(x).over(frame) - (F.lag(x, half).over(w) + F.lead(x, half).over(w)) / 2) / period
    full = F.count(x).over(frame) == 2 * half + 1
    t = dense.withColumns({"trend": F.when(full, centred), "_pos": F.row_number().over(w) - 1})
    t = t.withColumns({"_phase": F.pmod("_pos", F.lit(period)), "_detr": x - F.col("trend")})
    phase = t.groupBy(*keys, "_phase").agg(F.avg("_detr").alias("_pm"))
    mean = phase.groupBy(*keys).agg(F.avg("_pm").alias("_mm"))
    season = phase.join(mean, list(keys)).select(*keys, "_phase", (F.col("_pm") - F.col("_mm")).alias("seasonal"))
    return (
        t.join(season, [*keys, "_phase"])
        .withColumn("residual", F.col("_detr") - F.col("seasonal"))
        .drop("_pos", "_phase", "_detr")
    )


def seasonality_strength(parts: DataFrame, keys: tuple[str, ...] = ("first_category",), value: str = "sale_amount") -> DataFrame:
    """Population deviations of season and trend over that of the series."""
    total = F.stddev_pop(F.col(value).cast("double"))
    return parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        F.try_divide(F.stddev_pop("seasonal"), total).alias("seasonal_strength"),
        F.try_divide(F.stddev_pop("trend"), total).alias("trend_strength"),
    )


def holiday_effect(daily: DataFrame) -> DataFrame:
    h, a = F.col("holiday_flag"), F.col("sale_amount")
    return daily.groupBy("first_category").agg(
        F.coalesce(ratio(mean_if(h, a) - mean_if(~h, a), mean_if(~h, a)), F.lit(0.0)).alias("holiday_impact")
    )


def seasonality_lookup(daily: DataFrame) -> DataFrame:
    """Daily category rows with their monthly and weekly index (1 when unknown) and expected holiday impact."""
    idx = phase_indexes(daily)
    pick = lambda kind, name, key: idx.filter(F.col("kind") == kind).select(
        "first_category", F.col("phase").alias(key), F.col("index").alias(name)
    )
    out = daily.withColumns({"month": F.month("sale_date"), "day_of_week": F.weekday("sale_date")})
    out = out.join(pick("month", "_mi", "month"), ["first_category", "month"], "left")
    out = out.join(pick("weekday", "_wi", "day_of_week"), ["first_category", "day_of_week"], "left")
    out = out.join(holiday_effect(daily), "first_category", "left")
    return out.withColumns(
        {
            "monthly_seasonality": F.coalesce("_mi", F.lit(1.0)),
            "weekly_seasonality": F.coalesce("_wi", F.lit(1.0)),
            "expected_holiday_impact": F.col("holiday_impact") * F.col("holiday_flag").cast("int"),
        }
    ).drop("_mi", "_wi", "holiday_impact")
