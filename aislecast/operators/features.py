"""Feature frames: weather, category, store, time, lags, forecasting inputs, entity vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import climate
from ..functions.arrays import peak_hour, shopping_part
from ..functions.calendar import calendar_columns, cyclic_columns, is_weekend
from ..functions.core import mean_if, mean_of, ratio, safe_corr, slope_of, std_of
from ..session import written
from .relational import holiday_distance
from .series import lag_roll_features


def weather_features(weather: DataFrame) -> DataFrame:
    """Impact scores, comfort, seasonality and weekly volatility per city and day."""
    t, h, p, w = (F.col(c) for c in ("avg_temperature", "avg_humidity", "precpt", "avg_wind_level"))
    ext = weather.agg(
        F.struct(F.max(w).alias("wind"), F.min(t).alias("low"), F.max(t).alias("high"))
    ).scalar()
    base = weather.withColumn("_e", ext).withColumns(
        {
            "temp_impact": climate.temperature_impact(t),
            "humidity_impact": climate.humidity_impact(h),
            "rain_impact": climate.rain_impact(p),
            "wind_impact": climate.wind_impact(w, F.col("_e.wind")),
        }
    )
    scaled = ratio(t - F.col("_e.low"), F.col("_e.high") - F.col("_e.low"))
    week = W.partitionBy("city_id").orderBy("date").rowsBetween(-6, 0)
    full = F.count(F.lit(1)).over(week) == 7
    return base.withColumns(
        {
            "comfort_index": climate.comfort_index(
                F.col("temp_impact"), F.col("humidity_impact"), F.col("rain_impact"), F.col("wind_impact")
            ),
            "weather_seasonality": climate.weather_seasonality(scaled, F.month("date")),
            "temp_volatility": F.when(full, F.stddev_samp(t).over(week)),
            "humidity_volatility": F.when(full, F.stddev_samp(h).over(week)),
        }
    ).drop("_e")


def category_statistics(sales: DataFrame) -> DataFrame:
    """Per category: amount statistics, first sale, discount sensitivity (0 below 11 rows)."""
    return sales.groupBy("first_category").agg(
        mean_of("sale_amount").alias("category_mean"),
        std_of("sale_amount").alias("category_std"),
        F.min("sale_amount").alias("category_min"),
        F.max("sale_amount").alias("category_max"),
        F.count(F.lit(1)).alias("category_count"),
        F.min("sale_date").alias("introduced"),
        F.when(F.count(F.lit(1)) > 10, safe_corr("sale_amount", "discount")).otherwise(0.0).alias("discount_sensitivity"),
    )


def category_features(sales: DataFrame) -> DataFrame:
    """Category statistics, daily market share, monthly mean, store diversity and age joined to every sale.

    The sales are written once, with the columns given, and read by all aggregates.
    """
    sales = written(sales)
    stats = category_statistics(sales)
    day_cat = sales.groupBy("sale_date", "first_category").agg(F.sum("sale_amount").alias("_dc"))
    day = day_cat.groupBy("sale_date").agg(F.sum("_dc").alias("_d"))
    share = day_cat.join(day, "sale_date").select(
        "sale_date", "first_category", ratio("_dc", "_d").alias("category_market_share")
    )
    monthly = sales.groupBy("first_category", F.month("sale_date").alias("month")).agg(
        mean_of("sale_amount").alias("category_monthly_avg")
    )
    diversity = sales.groupBy("store_id").agg(F.count_distinct("first_category").alias("store_category_diversity"))
    return (
        sales.withColumn("month", F.month("sale_date"))
        .join(stats, "first_category")
        .join(share, ["sale_date", "first_category"])
        .join(monthly, ["first_category", "month"])
        .join(diversity, "store_id")
        .withColumn("category_days_since_introduction", F.date_diff("sale_date", "introduced"))
        .drop("introduced")
    )


def store_features(sales: DataFrame) -> DataFrame:
    """One row per store: statistics, weekend preference, loyalty, stock and promotion behaviour, city context."""
    promo, weekend = F.col("activity_flag"), is_weekend(F.col("sale_date"))
    mean, dev = mean_of("sale_amount"), std_of("sale_amount")
    per = sales.groupBy("store_id", "city_id").agg(
        mean.alias("store_mean"),
        dev.alias("store_std"),
        F.min("sale_amount").alias("store_min"),
        F.max("sale_amount").alias("store_max"),
        F.count(F.lit(1)).alias("store_count"),
        ratio(dev, mean).alias("store_sales_cv"),
        F.coalesce(ratio(mean_if(weekend, "sale_amount"), mean_if(~weekend, "sale_amount")), F.lit(1.0)).alias(
            "weekend_preference"
        ),
        F.coalesce(1 / (1 + ratio(dev, mean)), F.lit(0.5)).alias("loyalty"),
        mean_of("stock_hour6_22_cnt").alias("stock_efficiency"),
        F.coalesce(ratio(mean_if(promo, "sale_amount"), mean_if(~promo, "sale_amount")), F.lit(1.0)).alias(
            "promo_effectiveness"
        ),
    )
    city = sales.groupBy("city_id").agg(
        mean.alias("city_mean"), dev.alias("city_std"), F.count_distinct("store_id").alias("city_store_density")
    )
    return per.join(city, "city_id")


def store_shopping_part(hours: DataFrame) -> DataFrame:
    """Rows of each store by the part of day in which its sales peak."""
    part = shopping_part(peak_hour(F.col("hours_sale")))
    return hours.groupBy("store_id", part.alias("shopping_part")).agg(F.count(F.lit(1)).alias("rows"))


def temporal_features(df: DataFrame, days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Calendar and cyclic columns with days since and until a holiday."""
    return cyclic_columns(calendar_columns(df)).join(holiday_distance(days, holidays), "sale_date", "left")


def aggregate_category(sales: DataFrame, level: str = "category") -> DataFrame:
    """Sales by (date, category[, subcategory], store, city)."""
    sub = ["second_category"] if level == "subcategory" else []
    price = ratio("sale_amount", "units_sold")
    return sales.groupBy("sale_date", "first_category", *sub, "store_id", "city_id").agg(
        F.sum("sale_amount").alias("category_sales"),
        mean_of("sale_amount").alias("sale_amount_mean"),
        F.count(F.lit(1)).alias("sale_amount_count"),
        F.sum("units_sold").alias("sale_qty_sum"),
        mean_of("units_sold").alias("sale_qty_mean"),
        mean_of("discount").alias("discount_mean"),
        F.max("discount").alias("discount_max"),
        F.avg(price).alias("price_mean"),
        mean_of("stock_hour6_22_cnt").alias("stock_hours_mean"),
        F.max(F.col("holiday_flag").cast("int")).alias("holiday_flag"),
        mean_of(F.col("activity_flag").cast("int")).alias("promo_share"),
        *[F.avg(c).alias(f"{c}_mean") for c in ("avg_temperature", "avg_humidity", "precpt", "avg_wind_level")],
    )


def category_dynamics(cat: DataFrame, category: str = "first_category") -> DataFrame:
    """Velocity, volatility and trend slope (0 up to 10 rows) per category."""
    start = cat.agg(F.min("sale_date")).scalar()
    x = cat.withColumn("_x", F.date_diff("sale_date", start))
    return x.groupBy(category).agg(
        F.count(F.lit(1)).alias("rows"),
        mean_of("category_sales").alias("category_velocity"),
        F.coalesce(ratio(std_of("category_sales"), mean_of("category_sales")), F.lit(0.0)).alias("category_volatility"),
        F.when(F.count(F.lit(1)) > 10, slope_of("category_sales", "_x")).otherwise(0.0).alias("category_trend"),
    )


def category_share_columns(cat: DataFrame) -> DataFrame:
    """Share of the day, share of the store's day, and number of categories sold in the store that day."""
    day = cat.groupBy("sale_date").agg(F.sum("category_sales").alias("_day"))
    store = cat.groupBy("sale_date", "store_id").agg(
        F.sum("category_sales").alias("store_total_sales"), F.count_distinct("first_category").alias("store_category_count")
    )
    return (
        cat.join(day, "sale_date")
        .join(store, ["sale_date", "store_id"])
        .withColumns(
            {
                "category_market_share": ratio("category_sales", "_day"),
                "category_store_share": ratio("category_sales", "store_total_sales"),
            }
        )
        .drop("_day")
    )


def weather_model_features(daily: DataFrame, weather: DataFrame) -> DataFrame:
    """Daily city sales with weather scores, lags, interactions and deviation from the month's normal."""
    w = weather_features(weather).withColumnRenamed("date", "sale_date")
    normal = weather.groupBy("city_id", F.month("date").alias("month")).agg(F.avg("avg_temperature").alias("_normal"))
    out = lag_roll_features(daily, ["city_id"], "units_sold", lags=(1, 7), rolls=(7,))
    out = calendar_columns(out).join(w, ["city_id", "sale_date"]).join(normal, ["city_id", "month"])
    return out.withColumns(
        {
            "temp_humidity": F.col("avg_temperature") * F.col("avg_humidity") / 100,
            "temp_rain": F.col("avg_temperature") * F.col("precpt"),
            "wind_rain": F.col("avg_wind_level") * F.col("precpt"),
            "temp_deviation": F.col("avg_temperature") - F.col("_normal"),
        }
    ).drop("_normal")


def forecast_features(daily: DataFrame, keys: Sequence[str], value: str = "sale_amount") -> DataFrame:
    """Calendar, days since start, lags 1/7/30, full rolling means 7/30 and their gap; missing values are 0."""
    start = daily.agg(F.min("sale_date")).scalar()
    out = lag_roll_features(daily, keys, value, lags=(1, 7, 30), rolls=(7, 14, 30))
    out = calendar_columns(out).withColumn("days_since_start", F.date_diff("sale_date", start))
    keep = ["lag_1", "lag_7", "lag_30", "roll_mean_7", "roll_mean_30", "roll_gap"]
    base = [*keys, "sale_date", value, "day_of_week", "month", "quarter", "is_weekend", "days_since_start"]
    return out.select(*base, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in keep])


def demand_features(daily: DataFrame, weather: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Demand inputs: lags, one-row rolling means, weather products, stock-out impact."""
    out = lag_roll_features(daily, keys, "units_sold", lags=(1, 7, 30), rolls=(7, 14, 30), min_periods=True)
    w = weather.withColumnRenamed("date", "sale_date")
    return (
        calendar_columns(out)
        .join(w, ["city_id", "sale_date"], "left")
        .withColumns(
            {
                "temp_humidity": F.col("avg_temperature") * F.col("avg_humidity"),
                "temp_rain": F.col("avg_temperature") * F.col("precpt"),
                "stockout_impact": F.col("stock_hours") / 16,
            }
        )
    )


def future_frame(daily: DataFrame, keys: Sequence[str], horizon: int, value: str = "units_sold") -> DataFrame:
    """Next ``horizon`` days per series: calendar, mean of the last 30 rows, lags frozen at the last values."""
    down = W.partitionBy(*keys).orderBy(F.desc("sale_date"))
    tail = daily.withColumn("_r", F.row_number().over(down)).filter(F.col("_r") <= 30)
    pick = lambda n: F.max(F.when(F.col("_r") == n, F.col(value)))
    last = tail.groupBy(*keys).agg(
        F.max("sale_date").alias("_last"),
        mean_of(value).alias("mean_30"),
        ratio(F.sum(F.when(F.col("_r") <= 7, F.col(value))), F.count(F.when(F.col("_r") <= 7, F.col(value)))).alias("mean_7"),
        pick(1).alias("lag_1"),
        pick(7).alias("lag_7"),
        pick(30).alias("lag_30"),
        mean_of("discount").alias("discount_mean"),
    )
    days = F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))).alias("sale_date")
    out = last.select("*", days).drop("_last")
    return calendar_columns(out)


def store_vector(sales: DataFrame, hours: DataFrame) -> DataFrame:
    """Wide behaviour vector per store for clustering; three aggregations joined on the store."""
    promo, holiday, weekend = F.col("activity_flag"), F.col("holiday_flag"), is_weekend(F.col("sale_date"))
    price = ratio("sale_amount", "units_sold")
    mean, dev = mean_of("sale_amount"), std_of("sale_amount")
    base = sales.groupBy("store_id", "city_id").agg(
        F.sum("sale_amount").alias("total_sales"),
        mean.alias("mean_sales"),
        dev.alias("std_sales"),
        F.max("sale_amount").alias("max_sales"),
        F.count(F.lit(1)).alias("transactions"),
        F.sum("units_sold").alias("total_units"),
        mean_of("units_sold").alias("mean_units"),
        std_of("units_sold").alias("std_units"),
        mean_of("discount").alias("mean_discount"),
        F.max("discount").alias("max_discount"),
        F.avg(price).alias("mean_price"),
        F.stddev_samp(price).alias("std_price"),
        mean_of("stock_hour6_22_cnt").alias("mean_stock_hours"),
        ratio(F.count_if(F.col("stock_hour6_22_cnt") > 0), F.count(F.lit(1))).alias("stockout_rate"),
        ratio(F.count_if(holiday), F.count(F.lit(1))).alias("holiday_share"),
        ratio(F.count_if(promo), F.count(F.lit(1))).alias("promo_share"),
        (1 / (1 + ratio(dev, mean))).alias("consistency"),
        ratio(F.sum("units_sold"), F.sum("stock_level")).alias("turnover"),
        ratio(mean_if(weekend, "sale_amount"), mean_if(~weekend, "sale_amount")).alias("weekend_ratio"),
        ratio(mean_if(promo, "sale_amount"), mean_if(~promo, "sale_amount")).alias("promo_uplift"),
        ratio(mean_if(holiday, "sale_amount"), mean_if(~holiday, "sale_amount")).alias("holiday_boost"),
        safe_corr("sale_amount", "avg_temperature").alias("temp_corr"),
        safe_corr("sale_amount", "avg_humidity").alias("humidity_corr"),
        safe_corr("sale_amount", "precpt").alias("rain_corr"),
    )
    # distinct counts from a row per store and product, which has one first and second category
    items = sales.groupBy("store_id", "product_id").agg(F.first("first_category").alias("first_category"), F.first("second_category").alias("second_category"))
    kinds = items.groupBy("store_id", "first_category", "second_category").agg(F.count(F.lit(1)).alias("_n"))
    counts = kinds.groupBy("store_id").agg(
        F.sum("_n").alias("products"), F.count_distinct("first_category").alias("categories"), F.count_distinct("second_category").alias("subcategories")
    )
    seasonal = (
        sales.groupBy("store_id", F.month("sale_date").alias("_m"))
        .agg(mean_of("sale_amount").alias("_mm"))
        .groupBy("store_id")
        .agg(F.stddev_samp("_mm").alias("seasonal_variation"), F.max_by("_m", F.struct("_mm", -F.col("_m"))).alias("peak_month"))
    )
    clock = (
        hours.groupBy("store_id", peak_hour(F.col("hours_sale")).alias("_h"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("store_id")
        .agg(F.max_by("_h", F.struct("_n", -F.col("_h"))).alias("peak_hour"))
    )
    city = base.groupBy("city_id").agg(F.sum("total_sales").alias("_city"))
    return (
        base.join(counts, "store_id")
        .join(seasonal, "store_id")
        .join(clock, "store_id")
        .join(city, "city_id")
        .withColumn("city_market_share", ratio("total_sales", "_city"))
        .drop("_city")
    )


FEATURE_GROUPS = {
    "sales": ["total_amount", "mean_amount", "active_days"],
    "demand": ["demand_cv", "zero_ratio"],
    "stock": ["stockout_rate"],
    "weather": ["temp_corr", "humidity_corr", "rain_corr"],
    "discount": ["discount_response", "mean_discount"],
}


def entity_vector(sales: DataFrame, entity: str, groups: Sequence[str] | None = None) -> DataFrame:
    """Vector of one entity kind (product, store, city): metrics, demand variation, stock-outs, sensitivities."""
    disc = F.col("discount") > 0
    base = sales.groupBy(entity).agg(
        F.sum("sale_amount").alias("total_amount"),
        mean_of("sale_amount").alias("mean_amount"),
        ratio(F.count_if(F.col("stock_hour6_22_cnt") > 0), F.count(F.lit(1))).alias("stockout_rate"),
        F.coalesce(safe_corr("sale_amount", "avg_temperature"), F.lit(0.0)).alias("temp_corr"),
        F.coalesce(safe_corr("sale_amount", "avg_humidity"), F.lit(0.0)).alias("humidity_corr"),
        F.coalesce(safe_corr("sale_amount", "precpt"), F.lit(0.0)).alias("rain_corr"),
        F.coalesce(ratio(mean_if(disc, "sale_amount"), mean_if(~disc, "sale_amount")), F.lit(1.0)).alias("discount_response"),
        mean_of("discount").alias("mean_discount"),
    )
    daily = sales.groupBy(entity, "sale_date").agg(F.sum("units_sold").alias("_u"))
    demand = daily.groupBy(entity).agg(
        F.count(F.lit(1)).alias("active_days"),
        F.coalesce(ratio(std_of("_u"), mean_of("_u")), F.lit(0.0)).alias("demand_cv"),
        ratio(F.count_if(F.col("_u") == 0), F.count(F.lit(1))).alias("zero_ratio"),
    )
    wanted = [c for g in (groups or FEATURE_GROUPS) for c in FEATURE_GROUPS[g]]
    return base.join(demand, entity).select(entity, *wanted)
