"""Aggregations: two-stage statistics, concentration, trends, roll-ups, quality and profile reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import ladder, mean_if, mean_of, ratio, slope_of, std_of


def demand_statistics(daily: DataFrame, keys: Sequence[str], min_days: int = 1) -> DataFrame:
    """Daily sums, then mean, deviation, coefficient of variation and zero share per entity."""
    m, s = mean_of("units_sold"), std_of("units_sold")
    return (
        daily.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("days"),
            m.alias("mean_units"),
            s.alias("std_units"),
            ratio(s, m).alias("cv_units"),
            ratio(F.count_if(F.col("units_sold") == 0), F.count(F.lit(1))).alias("zero_ratio"),
            F.min("units_sold").alias("min_units"),
            F.max("units_sold").alias("max_units"),
        )
        .filter(F.col("days") >= min_days)
    )


def concentration(df: DataFrame, by: Sequence[str], item: str, value: str) -> DataFrame:
    """Sum of squared percentage shares and the share of the five largest items of each group."""
    per = df.groupBy(*by, item).agg(F.sum(value).alias("_v"))
    v = F.col("_v").cast("double")
    sums = per.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.sum("_v").alias("_t"), F.sum(v * v).alias("_vv"))
    # the five largest of each of 32 slices of a group, then the five largest of these
    some = W.partitionBy(*by, F.pmod(F.xxhash64(item), F.lit(32))).orderBy(F.desc("_v"), item)
    first = per.withColumn("_r", F.row_number().over(some)).filter(F.col("_r") <= 5)
    last = first.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_v"), item))).filter(F.col("_r") <= 5)
    five = last.groupBy(*by).agg(F.sum("_v").alias("_five"))
    total = F.col("_t").cast("double")
    return sums.join(five, list(by)).select(
        *by, "items", (F.try_divide(F.col("_vv"), total * total) * 10_000).alias("hhi"), (ratio("_five", "_t") * 100).alias("top5_share")
    )


def best_and_worst(df: DataFrame, by: Sequence[str], phase: str, value: str) -> DataFrame:
    """Phase (month, weekday, discount) with the highest and the lowest mean; ties go to the smaller phase."""
    per = df.groupBy(*by, phase).agg(mean_of(value).alias("_m"))
    p = F.col(phase)
    return per.groupBy(*by).agg(
        F.max_by(phase, F.struct("_m", -p)).alias("best"),
        F.max("_m").alias("best_mean"),
        F.min_by(phase, F.struct("_m", p)).alias("worst"),
        F.min("_m").alias("worst_mean"),
    )


def trend_slopes(daily: DataFrame, keys: Sequence[str], min_days: int = 11) -> DataFrame:
    """Regression slope of the daily amount on the day index counted from the first day of the series."""
    first = F.min("sale_date").over(W.partitionBy(*keys))
    indexed = daily.withColumn("_x", F.date_diff("sale_date", first))
    return (
        indexed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("days"), slope_of("sale_amount", "_x").alias("slope"))
        .filter(F.col("days") >= min_days)
    )


def ratio_profile(df: DataFrame, keys: Sequence[str], value: str, weekend: Column, promo: Column, holiday: Column) -> DataFrame:
    """Weekend to weekday, promotion to regular and holiday to regular ratios of means."""
    return df.groupBy(*keys).agg(
        ratio(mean_if(weekend, value), mean_if(~weekend, value)).alias("weekend_ratio"),
        ratio(mean_if(promo, value), mean_if(~promo, value)).alias("promo_ratio"),
        ratio(mean_if(holiday, value), mean_if(~holiday, value)).alias("holiday_ratio"),
    )


def level_rollup(df: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """Totals per day by each level and overall, in one pass of grouping sets."""
    sets = [[F.col("sale_date"), F.col(level)] for level in levels] + [[F.col("sale_date")]]
    cols = [F.col("sale_date"), *[F.col(level) for level in levels]]
    return (
        df.groupingSets(sets, *cols)
        .agg(F.grouping_id().alias("_gid"), F.sum(value).alias("total"), F.count(F.lit(1)).alias("rows"))
        .withColumn("level", _level_name(levels))
        .drop("_gid")
    )


def _level_name(levels: Sequence[str]) -> Column:
    out = None
    n = len(levels)
    for i, level in enumerate(levels):
        others = sum(1 << (n - 1 - j) for j in range(n) if j != i)
        out = F.when(F.col("_gid") == others, level) if out is None else out.when(F.col("_gid") == others, level)
    return out.otherwise("total")


def quality_summary(df: DataFrame, columns: Sequence[str], day: str = "sale_date") -> DataFrame:
    """Rows, span in days, completeness per column in percent, and the range of each column."""
    aggs = [
        F.count(F.lit(1)).alias("sample_size"),
        (F.date_diff(F.max(day), F.min(day)) + 1).alias("span_days"),
    ]
    for c in columns:
        aggs += [
            (ratio(F.count(c), F.count(F.lit(1))) * 100).alias(f"{c}_complete_pct"),
            F.min(c).cast("double").alias(f"{c}_min"),
            F.max(c).cast("double").alias(f"{c}_max"),
        ]
    return df.agg(*aggs)


DISCOUNT_BANDS = [(0.0, "none"), (0.1, "up to 10%"), (0.2, "up to 20%"), (0.3, "up to 30%")]


def discount_band(discount: Column) -> Column:
    """Band of a discount fraction: none, <= 10 %, <= 20 %, <= 30 %, above."""
    return ladder(discount, DISCOUNT_BANDS, "over 30%", op="<=")


def depth_band(discount: Column) -> Column:
    """Depth class of a discount fraction; no discount is a class of its own."""
    pct = discount * 100
    return (
        F.when(pct <= 0, "none")
        .when(pct < 10, "light")
        .when(pct < 20, "moderate")
        .when(pct < 30, "deep")
        .when(pct < 50, "very_deep")
        .otherwise("extreme")
    )


def sales_profile(sales: DataFrame) -> DataFrame:
    """Mean, total and rows by holiday flag and by discount band."""

    def by(kind, label):
        return sales.groupBy(label.alias("label")).agg(
            F.lit(kind).alias("profile"),
            F.count(F.lit(1)).alias("rows"),
            mean_of("sale_amount").alias("mean_amount"),
            F.sum("sale_amount").alias("total_amount"),
        )

    holiday = F.when(F.col("holiday_flag"), "holiday").otherwise("regular")
    return by("holiday", holiday).unionByName(by("discount", discount_band(F.col("discount"))))


def weather_profile(weather: DataFrame) -> DataFrame:
    """Days and weather minimum, mean and maximum of each city."""
    cols = ("avg_temperature", "avg_humidity", "precpt", "avg_wind_level")
    aggs = [F.count(F.lit(1)).alias("days")]
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max")]
    return weather.groupBy("city_id").agg(*aggs)


def store_statistics(sales: DataFrame) -> DataFrame:
    return sales.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("sales_count"),
        F.sum("sale_amount").alias("total_amount"),
        mean_of("units_sold").alias("avg_units"),
        F.min("sale_date").alias("first_sale"),
        F.max("sale_date").alias("last_sale"),
    )


def label_lists(product: DataFrame) -> DataFrame:
    """Categories with the sorted list of their distinct labels, product count and mean price."""
    labels = (
        product.select("first_category", "second_category")
        .distinct()
        .groupBy("first_category")
        .agg(F.array_join(F.array_sort(F.collect_list("second_category")), ", ").alias("labels"))
    )
    stats = product.groupBy("first_category").agg(
        F.count(F.lit(1)).alias("products"), mean_of("list_price").alias("avg_price")
    )
    return stats.join(labels, "first_category")


def daily_view(sales: DataFrame) -> DataFrame:
    """Daily sales summary by date, store, city, product and categories."""
    return sales.groupBy("sale_date", "store_id", "city_id", "product_id", "first_category", "second_category").agg(
        F.sum("sale_amount").alias("total_amount"),
        F.sum("units_sold").alias("total_units"),
        mean_of("discount").alias("avg_discount"),
        F.count(F.lit(1)).alias("transactions"),
        F.bool_or("holiday_flag").alias("is_holiday"),
        F.bool_or("activity_flag").alias("is_promo"),
    )


WIDE = 1000  # columns of a matrix at most


def entity_day_matrix(daily: DataFrame, entity: str, value: str, dimension: DataFrame) -> DataFrame:
    """Day x entity matrix (mean, zero where absent); the entities are the labels in ``dimension``, at most ``WIDE`` of them."""
    entities = sorted(r[0] for r in dimension.select(entity).distinct().dropna().limit(WIDE + 1).collect())
    if len(entities) > WIDE:
        raise ValueError(f"more than {WIDE} values of {entity}: a matrix would be too wide")
    wide = daily.groupBy("sale_date").pivot(entity, entities).agg(mean_of(value))
    return wide.select("sale_date", *[F.coalesce(F.col(f"`{e}`"), F.lit(0.0)).alias(str(e).lower()) for e in entities])
