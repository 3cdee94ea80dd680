"""Holiday lift and sensitivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import clamp, ladder, mean_if, mean_of


def holiday_lift(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Holiday against ordinary mean per key; keys lacking either kind are left out."""
    h = F.col("holiday_flag")
    g = sales.groupBy(*keys).agg(
        mean_if(h, "sale_amount").alias("avg_holiday_sales"),
        mean_if(~h, "sale_amount").alias("avg_regular_sales"),
        F.count_if(h).alias("holiday_count"),
    )
    lift = F.col("avg_holiday_sales") - F.col("avg_regular_sales")
    return g.dropna(subset=["avg_holiday_sales", "avg_regular_sales"]).withColumns(
        {
            "absolute_lift": lift,
            "percentage_lift": F.when(F.col("avg_regular_sales") > 0, lift / F.col("avg_regular_sales") * 100).otherwise(0.0),
        }
    )


def holiday_lift_by_day(sales: DataFrame, holidays: DataFrame, span_weeks: int = 4) -> DataFrame:
    """Each holiday's total against the mean total of the same weekday within +-``span_weeks`` weeks."""
    daily = sales.groupBy("sale_date").agg(F.sum("sale_amount").alias("total"))
    offsets = [7 * i for i in range(-span_weeks, span_weeks + 1) if i != 0]
    look = holidays.select("date", F.explode(F.array(*[F.date_add("date", o) for o in offsets])).alias("sale_date"))
    base = daily.join(look, "sale_date").groupBy("date").agg(mean_of("total").alias("normal_sales"))
    hol = daily.join(holidays, daily.sale_date == holidays.date).select("date", "holiday_name", F.col("total").alias("holiday_sales"))
    lift = F.col("holiday_sales").cast("double") - F.col("normal_sales")
    return hol.join(base, "date").withColumns(
        {"sales_lift": lift, "sales_lift_pct": F.when(F.col("normal_sales") > 0, lift / F.col("normal_sales") * 100).otherwise(0.0)}
    )


def holiday_boost(sales: DataFrame, keys: Sequence[str], min_rows: int = 3) -> DataFrame:
    """Boost factor in 0.8..1.5; a flag with too few rows counts as 1, as does a key without any."""
    h = F.col("holiday_flag")
    g = sales.groupBy(*keys).agg(
        F.count_if(h).alias("_nh"),
        F.count_if(~h).alias("_nr"),
        mean_if(h, "sale_amount").alias("_h"),
        mean_if(~h, "sale_amount").alias("_r"),
    )
    hol = F.when(F.col("_nh") >= min_rows, F.col("_h")).otherwise(1.0)
    reg = F.when(F.col("_nr") >= min_rows, F.col("_r")).otherwise(1.0)
    none = (F.col("_nh") < min_rows) & (F.col("_nr") < min_rows)
    boost = F.when(none, 1.0).otherwise(clamp(F.when(reg > 0, hol / reg).otherwise(1.0), 0.8, 1.5))
    return g.select(*keys, boost.alias("holiday_boost")).withColumn("sensitive", F.col("holiday_boost") > 1.15)


def holiday_status(boost: DataFrame) -> DataFrame:
    """Mean boost of the keys that react and the status it stands for."""
    changed = F.col("holiday_boost") != 1.0
    g = boost.agg(
        F.coalesce(F.avg(F.when(changed, F.col("holiday_boost"))), F.lit(1.0)).alias("mean_boost"),
        F.count_if("sensitive").alias("sensitive_keys"),
    )
    return g.withColumn("status", ladder("mean_boost", [(1.1, "holiday_period"), (1.05, "pre_holiday")], "normal", op=">"))


def holiday_names_by_cycle(days: DataFrame, names: Sequence[str]) -> DataFrame:
    """Names handed out in turn to the holiday dates in date order (a calendar-sized frame)."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("date")) - 1
    labels = F.array(*map(F.lit, names))
    return days.withColumn("cyclic_name", F.element_at(labels, (F.pmod(n, F.lit(len(names))) + 1).cast("int")))


