"""Ordered operators over series; every window is partitioned by the series key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import ratio, std_of


def series_window(keys: Sequence[str], day: str = "sale_date"):
    return W.partitionBy(*keys).orderBy(day)


def full_frame(agg, value: Column, w, n: int) -> Column:
    """Aggregate over the last ``n`` rows, NULL until ``n`` non-null values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def exact_mean(value: Column):
    return lambda w: ratio(F.sum(value).over(w), F.count(value).over(w))


def lag_roll_features(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    lags: Sequence[int] = (1, 7, 14, 30),
    rolls: Sequence[int] = (7, 14, 30),
    min_periods: bool = False,
    day: str = "sale_date",
) -> DataFrame:
    """Lags, rolling mean, deviation, minimum and maximum, and short and long trend; one sort serves all."""
    w, x = series_window(keys, day), F.col(value)
    cols = {f"lag_{n}": F.lag(x, n).over(w) for n in lags}
    for n in rolls:
        frame = w.rowsBetween(-(n - 1), 0)
        full = F.lit(True) if min_periods else F.count(x).over(frame) == n
        cols[f"roll_mean_{n}"] = F.when(full, ratio(F.sum(x).over(frame), F.count(x).over(frame)))
        cols[f"roll_std_{n}"] = F.when(full, F.stddev_samp(x.cast("double")).over(frame))
        cols[f"roll_min_{n}"] = F.when(full, F.min(x).over(frame))
        cols[f"roll_max_{n}"] = F.when(full, F.max(x).over(frame))
    out = df.withColumns(cols)
    trends = {}
    if 7 in rolls and 7 in lags:
        trends["short_trend"] = ratio(F.col("roll_mean_7") - F.col("lag_7"), F.nullif(F.col("lag_7"), F.lit(0)))
    if 30 in rolls and 30 in lags:
        trends["long_trend"] = ratio(F.col("roll_mean_30") - F.col("lag_30"), F.nullif(F.col("lag_30"), F.lit(0)))
    if 7 in rolls and 14 in rolls:
        trends["roll_gap"] = F.col("roll_mean_7") - F.col("roll_mean_14")
    return out.withColumns(trends)


def moving_baseline(df: DataFrame, keys: Sequence[str], value: str, first: int = -21, last: int = -8) -> DataFrame:
    """Week-ago value, mean and deviation of the rows ``first`` to ``last`` before, and the z-score against them."""
    w, x = series_window(keys), F.col(value)
    frame = w.rowsBetween(first, last)
    mean = ratio(F.sum(x).over(frame), F.count(x).over(frame))
    dev = F.stddev_samp(x.cast("double")).over(frame)
    return df.withColumns({"week_ago": F.lag(x, 7).over(w), "baseline_mean": mean, "baseline_std": dev}).withColumn(
        "z_score",
        F.when(F.col("baseline_std") > 0, (x - F.col("baseline_mean")) / F.col("baseline_std")).otherwise(0.0),
    )


def pct_change(df: DataFrame, keys: Sequence[str], value: str, name: str = "pct_change") -> DataFrame:
    prev = F.lag(value).over(series_window(keys))
    return df.withColumn(name, ratio(F.col(value) - prev, prev))


def tail_rank(df: DataFrame, keys: Sequence[str], name: str = "from_end") -> DataFrame:
    """Row number counted from the newest row of each series (1 = newest)."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("sale_date"))))


def recent_change(df: DataFrame, keys: Sequence[str], value: str, tail: int = 14) -> DataFrame:
    """Mean relative change over the newest ``tail`` rows of each series."""
    ranked = tail_rank(pct_change(df, keys, value), keys)
    return (
        ranked.filter(F.col("from_end") <= tail)
        .groupBy(*keys)
        .agg(F.avg("pct_change").alias("mean_change"), F.count(F.lit(1)).alias("rows"))
    )


def differences(df: DataFrame, keys: Sequence[str], value: str, n: int = 7, day: str = "sale_date") -> DataFrame:
    """First difference and rolling deviation over ``n`` rows."""
    w, x = series_window(keys, day), F.col(value)
    return df.withColumns(
        {f"{value}_diff": x - F.lag(x).over(w), f"{value}_volatility": full_frame(F.stddev_samp, x, w, n)}
    )


def head_tail_growth(df: DataFrame, keys: Sequence[str], value: str, n: int = 30) -> DataFrame:
    """Means of the first, the last and the previous ``n`` rows, and last against first in percent."""
    ranked = df.withColumns(
        {
            "_up": F.row_number().over(W.partitionBy(*keys).orderBy("sale_date")),
            "_down": F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("sale_date"))),
        }
    )
    x = F.col(value)

    def mean(cond):
        return ratio(F.sum(F.when(cond, x)), F.count(F.when(cond, x)))

    return ranked.groupBy(*keys).agg(
        mean(F.col("_up") <= n).alias("first_mean"),
        mean(F.col("_down") <= n).alias("last_mean"),
        mean(F.col("_down").between(n + 1, 2 * n)).alias("previous_mean"),
    ).withColumns(
        {
            "growth_pct": ratio(F.col("last_mean") - F.col("first_mean"), "first_mean") * 100,
            "recent_growth_pct": ratio(F.col("last_mean") - F.col("previous_mean"), "previous_mean") * 100,
        }
    )


def longest_run(df: DataFrame, keys: Sequence[str], cond: Column, day: str, name: str = "longest_run") -> DataFrame:
    """Longest run of consecutive rows for which ``cond`` holds; 0 where it never does."""
    w = W.partitionBy(*keys).orderBy(day)
    flagged = df.withColumn("_on", cond).withColumn("_island", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w))
    runs = flagged.groupBy(*keys, "_island").agg(F.count_if("_on").alias("_len"))
    return runs.groupBy(*keys).agg(F.max("_len").alias(name))


def deviation_from_group(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Value minus the mean of its group; the mean is aggregated and joined, so a hot group is not one task."""
    means = df.groupBy(*group).agg(F.avg(value).alias("_m"))
    return df.join(means, list(group), "left").withColumn(name, F.col(value) - F.col("_m")).drop("_m")


def share_of_total(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Entity totals with share of the grand total and ratio to the mean entity."""
    per = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    grand = per.agg(F.sum("total").cast("double")).scalar()
    n = per.agg(F.count(F.lit(1))).scalar()
    return per.withColumns(
        {
            "share_pct": ratio("total", grand) * 100,
            "relative_to_mean": ratio("total", grand / n),
        }
    )


def equal_width_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Bin 1..n of equal width between the column's minimum and maximum; the maximum falls in the last bin."""
    span = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    x, low, high = F.col(value), F.col("_span.low"), F.col("_span.high")
    raw = F.floor((x - low) * bins / F.nullif(high - low, F.lit(0.0))) + 1
    return df.withColumn("_span", span).withColumn(name, F.least(raw, F.lit(bins)).cast("int")).drop("_span")


def phase_statistics(daily: DataFrame, keys: Sequence[str], phase: Column, value: str) -> DataFrame:
    """Mean, deviation and rows by calendar phase."""
    return daily.groupBy(*keys, phase.alias("phase")).agg(
        ratio(F.sum(value), F.count(value)).alias("mean_value"),
        std_of(value).alias("std_value"),
        F.count(F.lit(1)).alias("rows"),
    )
