"""Promotion uplift, cross effects, recommendations, impact and weather interaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import ladder, mean_if, mean_of, ratio, share_if, slope_of
from ..session import written
from .ranking import exact_quantiles, with_percent_rank
from .relational import apply_promotions
from .summaries import depth_band

DISCOUNT_GRID = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)


def promoted(flag: str | None = None) -> Column:
    return F.col(flag) if flag else F.col("discount") > 0


def uplift_by_level(sales: DataFrame, item: str = "product_id", min_rows: int = 30) -> DataFrame:
    """Uplift of each item overall, by discount depth and by store, against the item's (or store's) regular mean."""
    p = promoted()
    base = sales.groupBy(item).agg(
        F.count(F.lit(1)).alias("rows"),
        mean_if(~p, "sale_amount").alias("baseline"),
        mean_if(p, "sale_amount").alias("promoted"),
        share_if(p).alias("frequency"),
    ).filter((F.col("rows") >= min_rows) & F.col("baseline").isNotNull() & F.col("promoted").isNotNull())
    overall = base.select(item, F.lit("overall").alias("level"), F.lit("all").alias("member"), "baseline", "promoted", F.col("rows").alias("sample"))
    depth = (
        sales.filter(p)
        .groupBy(item, depth_band(F.col("discount")).alias("member"))
        .agg(mean_of("sale_amount").alias("promoted"), F.count(F.lit(1)).alias("sample"))
        .join(base.select(item, "baseline"), item)
        .select(item, F.lit("depth").alias("level"), "member", "baseline", "promoted", "sample")
    )
    store = (
        sales.groupBy(item, F.col("store_id").cast("string").alias("member"))
        .agg(
            mean_if(~p, "sale_amount").alias("baseline"),
            mean_if(p, "sale_amount").alias("promoted"),
            F.count(F.lit(1)).alias("sample"),
        )
        .join(base.select(item), item, "left_semi")
        .filter((F.col("baseline") > 0) & F.col("promoted").isNotNull())
        .select(item, F.lit("store").alias("level"), "member", "baseline", "promoted", "sample")
    )
    out = overall.unionByName(depth).unionByName(store)
    return out.withColumn("uplift_pct", ratio(F.col("promoted") - F.col("baseline"), "baseline") * 100)


def cross_effects(daily: DataFrame, pairs: DataFrame, item: str, keys: Sequence[str] = (), min_rows: int = 10) -> DataFrame:
    """Effect of promoting ``item_a`` on ``item_b``: mean of b on a's promotion days against its other days.

    ``daily`` has one row per key, item and day with ``activity_flag``; ``pairs`` names the pairs to look at,
    for instance the correlated ones.  With ``keys`` the effect is measured inside each key (a store).  ``sale_amount`` is exact
    (integer or decimal), so the sums of the other days are those of all days less those of the promoted ones.
    """
    keys = list(keys)
    daily = written(daily.select(*keys, item, "sale_date", "sale_amount", "activity_flag"))  # read three times
    v = F.col("sale_amount")
    seen = daily.groupBy(*keys, item).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("activity_flag").alias("_p"), F.sum(v).alias("_sum"), F.count(v).alias("_count")
    ).filter(F.col("_n") >= min_rows)
    on = daily.filter("activity_flag").groupBy(*keys, F.col(item).alias("item_a"), "sale_date").agg(F.count(F.lit(1)).alias("_m"))
    both = pairs.select("item_a", "item_b").distinct().join(seen.filter(F.col("_p") > 0).select(*keys, F.col(item).alias("item_a")), "item_a")
    both = both.join(seen.select(*keys, F.col(item).alias("item_b")), [*keys, "item_b"])
    b = daily.select(*keys, F.col(item).alias("item_b"), "sale_date", v)
    if keys:  # what a key sells on a day is little next to all days of its pairs
        rows = b.join(on, [*keys, "sale_date"]).join(both, [*keys, "item_a", "item_b"], "left_semi")
    else:
        rows = both.join(on, "item_a").join(b, ["item_b", "sale_date"])
    # promoted days are met; the other days are what is left of the sums over all days
    met = rows.groupBy(*keys, "item_a", "item_b").agg(
        F.sum(v * F.col("_m")).alias("_during"), F.sum(F.when(v.isNotNull(), F.col("_m"))).alias("_on"), F.sum(v).alias("_taken"), F.count(v).alias("_days")
    )
    total = seen.select(*keys, F.col(item).alias("item_b"), "_sum", "_count")
    g = met.join(total, [*keys, "item_b"]).select(
        *keys, "item_a", "item_b", ratio("_during", "_on").alias("during"), ratio(F.col("_sum") - F.col("_taken"), F.col("_count") - F.col("_days")).alias("normal")
    ).filter((F.col("normal") > 0) & F.col("during").isNotNull())
    g = g.withColumn("impact_pct", (F.col("during") - F.col("normal")) / F.col("normal") * 100)
    x = F.col("impact_pct")
    return g.withColumns(
        {
            "impact_type": F.when(x > 0, "positive").otherwise("negative"),
            "significance": ladder(F.abs(x), [(15, "high"), (5, "moderate")], "low", op=">"),
            "cannibalisation": ladder("impact_pct", [(-20, "high"), (-10, "moderate")], "low", op="<"),
        }
    )


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("item_a", "item_b").unionByName(
        pairs.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"))
    )


def effectiveness(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Uplift, frequency, best discount and number of promotions by flag, or by discount where no flag contrast exists."""
    flag, disc = F.col("activity_flag"), F.col("discount") > 0
    span = F.greatest(F.date_diff(F.max("sale_date"), F.min("sale_date")), F.lit(1))
    g = sales.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        span.alias("_span"),
        F.count_if(flag).alias("_nf"),
        mean_if(flag, "sale_amount").alias("_pf"),
        mean_if(~flag, "sale_amount").alias("_rf"),
        F.count_if(disc).alias("_nd"),
        mean_if(disc, "sale_amount").alias("_pd"),
        mean_if(~disc, "sale_amount").alias("_rd"),
    )

    def best(cond, name):
        per = sales.filter(cond).groupBy(*keys, "discount").agg(mean_of("sale_amount").alias("_m"))
        return per.groupBy(*keys).agg(F.max_by("discount", F.struct("_m", -F.col("discount"))).alias(name))

    g = g.join(best(flag, "_bf"), list(keys), "left").join(best(disc, "_bd"), list(keys), "left")
    by_flag = (F.col("_nf") > 0) & (F.col("_nf") < F.col("_n"))
    base = F.coalesce("_rd", "_pd")
    up = F.when(by_flag, ratio(F.col("_pf") - F.col("_rf"), "_rf")).otherwise(ratio(F.col("_pd") - base, base))
    return g.select(
        *keys,
        F.coalesce(up * 100, F.lit(0.0)).alias("average_uplift"),
        F.when(by_flag, ratio("_nf", "_span") * 100).otherwise(ratio("_nd", "_n") * 100).alias("promotion_frequency"),
        F.coalesce(F.when(by_flag, F.col("_bf")).otherwise(F.col("_bd")).cast("double"), F.lit(0.0)).alias("best_discount"),
        F.when(by_flag, F.col("_nf")).otherwise(F.col("_nd")).alias("total_promotions"),
    )


def recommend_discounts(sales: DataFrame, keys: Sequence[str], min_rows: int = 2) -> DataFrame:
    """Every useful discount level (5 to 60 %) of each key with uplift, length and return.

    A level counts from ``min_rows`` sales on; negative uplift is reported as 0.
    """
    pct = F.round(F.col("discount") * 100, 2).cast("double")
    base = sales.groupBy(*keys).agg(F.coalesce(mean_if(F.col("discount") == 0, "sale_amount"), mean_of("sale_amount")).alias("_base"))
    per = (
        sales.withColumn("discount_pct", pct)
        .filter(F.col("discount_pct").between(5, 60))
        .groupBy(*keys, "discount_pct")
        .agg(F.count(F.lit(1)).alias("rows"), mean_of("sale_amount").alias("_a"))
        .filter(F.col("rows") >= min_rows)
        .join(base, list(keys))
    )
    up = ratio(F.col("_a") - F.col("_base"), "_base") * 100
    out = per.withColumn("_u", up)
    return out.select(
        *keys,
        "discount_pct",
        "rows",
        F.greatest(F.lit(0.0), F.col("_u")).alias("estimated_uplift"),
        ladder("rows", [(21, "long"), (14, "medium")], "short", op=">").alias("duration"),
        ratio(F.col("_u") / 100 - F.col("discount_pct") / 100, F.col("discount_pct") / 100).alias("estimated_roi"),
        F.when(F.col("_u") < 0, "conservative").when(F.col("_u") < 10, "balanced").otherwise("data_driven").alias("strategy"),
    )


def promotion_strategies(effects: DataFrame, baseline: DataFrame, keys: Sequence[str], unlikely: float = 50.0) -> DataFrame:
    """Three options per key: conservative where promotions have hurt, balanced where their uplift is unlikely, else by its history.

    ``effects`` has average_uplift (percent) and best_discount (share), ``baseline`` the mean regular sale of a key.
    """
    j = effects.join(baseline, list(keys))
    b, u = F.col("baseline_sales"), F.col("average_uplift")
    best = F.col("best_discount") * 100
    best = F.when(best > 60, 25.0).when(best < 5, 15.0).otherwise(best)
    strong, soft = F.least(best * 1.3, F.lit(35.0)), F.greatest(best * 0.7, F.lit(10.0))

    def option(n, discount, days, uplift, sales, roi):
        values = [F.lit(n), *[x if isinstance(x, Column) else F.lit(x) for x in (discount, days, uplift, sales, roi)]]
        names = ("option", "discount", "duration_days", "estimated_uplift", "incremental_sales", "estimated_roi")
        kinds = ("int", "double", "int", "double", "bigint", "double")
        return F.struct(*[v.cast(k).alias(c) for v, c, k in zip(values, names, kinds)])

    # fixed values: the levels, lengths and shares of the three strategies
    conservative = F.array(*[
        option(i, d, n, up, F.greatest(F.lit(i), F.floor(b * (up / 100) * n)), roi)
        for i, d, n, up, roi in ((1, 5.0, 3, 2.0, 0.40), (2, 10.0, 5, 5.0, 0.50), (3, 15.0, 7, 8.0, 0.53))
    ])
    balanced = F.array(*[
        option(i + 1, d, max(3, 7 - i), d * 1.5, F.greatest(F.lit(2), F.floor(b * (d * 0.015) * (7 - i))), (1 + d * 0.015) / (d / 100))
        for i, d in enumerate((12.0, 20.0, 30.0))
    ])
    data_driven = F.array(*[
        option(i, d, n, F.greatest(F.lit(low), u * k), F.greatest(F.lit(few), F.floor(b * (u * k / 100))), F.greatest(F.lit(least), (u * k / 100) / (by / 100)))
        for i, d, by, n, low, k, few, least in (
            (1, F.least(best, F.lit(25.0)), best, 7, 5.0, 0.8, 3, 0.5), (2, strong, strong, 10, 8.0, 1.1, 5, 0.6), (3, soft, soft, 5, 3.0, 0.6, 2, 0.4)
        )
    ])
    kind = F.when(u < 0, "conservative").when(u > unlikely, "balanced").otherwise("data_driven")
    options = F.when(u < 0, conservative).when(u > unlikely, balanced).otherwise(data_driven)
    return j.select(*keys, kind.alias("strategy"), F.explode(options).alias("o")).select(*keys, "strategy", "o.*")


def group_uplift(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Promotion mean, regular mean, uplift and percent for groups that have both."""
    p = F.col("activity_flag")
    g = sales.groupBy(*keys).agg(mean_if(p, "sale_amount").alias("promo_sales"), mean_if(~p, "sale_amount").alias("regular_sales"))
    g = g.dropna(subset=["promo_sales", "regular_sales"])
    up = F.col("promo_sales") - F.col("regular_sales")
    return g.withColumns({"uplift": up, "uplift_pct": ratio(up, "regular_sales") * 100})


def row_uplift(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Promoted sales with their relative gap to the regular mean of the group."""
    base = sales.filter(~F.col("activity_flag")).groupBy(*keys).agg(mean_of("sale_amount").alias("regular_mean"))
    return sales.filter("activity_flag").join(base, list(keys)).withColumn(
        "row_uplift", ratio(F.col("sale_amount").cast("double") - F.col("regular_mean"), "regular_mean")
    )


def effectiveness_table(rows: DataFrame, keys: Sequence[str], value: str = "row_uplift") -> DataFrame:
    """Mean, median, deviation, rows and percentile rank of the mean uplift per group."""
    g = rows.groupBy(*keys).agg(
        F.avg(value).alias("uplift_mean"), F.stddev_samp(value).alias("uplift_std"), F.count(F.lit(1)).alias("uplift_count")
    )
    med = exact_quantiles(rows, value, {"uplift_median": 0.5}, keys)
    ranked = with_percent_rank(g.join(med, list(keys)), "uplift_mean", "_p")
    return ranked.withColumn("uplift_percentile", F.col("_p") * 100).drop("_p")


DISCOUNT_CLASSES = [(0.0, "no_discount"), (0.1, "low_discount"), (0.2, "medium_discount"), (0.3, "high_discount")]


def discount_class(d: Column) -> Column:
    return ladder(d, DISCOUNT_CLASSES, "very_high_discount", op="<=")


def discount_impact(sales: DataFrame, keys: Sequence[str], discount: float, min_rows: int = 3) -> DataFrame:
    """Expected increase (at least 5 %) at a discount from history, with 30-day base revenue; 15 % and 100 without history."""
    target = "very_high_discount"
    for bound, name in DISCOUNT_CLASSES[1:]:
        if discount <= bound:
            target = name
            break
    cls = sales.groupBy(*keys, discount_class(F.col("discount")).alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"), mean_of("sale_amount").alias("_m")
    )
    ok = F.col("_n") >= min_rows
    g = cls.groupBy(*keys).agg(
        F.count_if(ok).alias("_classes"),
        F.max(F.when(ok & (F.col("_c") == "no_discount"), F.col("_m"))).alias("_b"),
        F.max(F.when(ok & (F.col("_c") == target), F.col("_m"))).alias("_t"),
    )
    base = F.coalesce("_b", F.lit(1.0))
    inc = F.greatest(F.lit(0.05), F.coalesce("_t", base) / base - 1)
    return g.select(
        *keys,
        F.when(F.col("_classes") == 0, 0.15).otherwise(inc).alias("expected_increase"),
        F.when(F.col("_classes") == 0, 100.0).otherwise(base * 30).alias("base_revenue"),
    )


def promotion_impact(impact: DataFrame, weather: DataFrame, holiday: DataFrame, keys: Sequence[str], discount: float) -> DataFrame:
    """Expected sales and revenue effect with weather and holiday boosts, label and timing."""
    j = impact.join(weather, list(keys), "left").join(holiday, list(keys), "left")
    wb, hb = F.coalesce("weather_boost", F.lit(1.0)), F.coalesce("holiday_boost", F.lit(1.0))
    j = j.withColumns({"weather_boost": wb, "holiday_boost": hb})
    inc = F.col("expected_increase") * (F.col("weather_boost") * F.col("holiday_boost"))
    j = j.withColumn("sales_increase", inc)
    rev = F.col("base_revenue") * (1 + F.col("sales_increase")) * (1 - F.lit(discount)) - F.col("base_revenue")
    j = j.withColumn("revenue_impact", rev)
    s, r, w, h = (F.col(c) for c in ("sales_increase", "revenue_impact", "weather_boost", "holiday_boost"))
    label = (
        F.when((r > 25) & (s > 0.20), "HIGHLY RECOMMENDED")
        .when((r > 0) & (s > 0.10), "RECOMMENDED")
        .when((r > -10) & (s > 0.08), "MODERATE")
        .otherwise("NOT RECOMMENDED")
    )
    timing = (
        F.when((w > 1.15) & (h > 1.1), "OPTIMAL")
        .when((w > 1.15) | (h > 1.1), "GOOD")
        .when((w < 0.9) | (h < 0.9), "POOR")
        .otherwise("NEUTRAL")
    )
    return j.withColumns({"recommendation": label, "timing": timing}).drop("sensitive")


def promotion_days_effect(
    sales: DataFrame, promotions: DataFrame, kind: str | None = None, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Sales under promotions from the interval join, optionally of one type or discount range, by type and percent."""
    rows = apply_promotions(sales, promotions)
    if kind is not None:
        rows = rows.filter(F.col("promotion_type") == kind)
    if low is not None:
        rows = rows.filter(F.col("promotion_discount") >= low)
    if high is not None:
        rows = rows.filter(F.col("promotion_discount") <= high)
    return rows.groupBy("promotion_type", "promotion_discount").agg(
        F.count(F.lit(1)).alias("rows"), mean_of("sale_amount").alias("mean_amount"), F.sum("units_sold").alias("units")
    )


def price_elasticity(sales: DataFrame, keys: Sequence[str], min_rows: int = 10) -> DataFrame:
    """Slope of log units on log unit price."""
    ok = sales.filter((F.col("units_sold") > 0) & (F.col("sale_amount") > 0))
    price = F.col("sale_amount").cast("double") / F.col("units_sold")
    logs = ok.withColumns({"_q": F.ln(F.col("units_sold").cast("double")), "_p": F.ln(price)})
    return logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), slope_of("_q", "_p").alias("elasticity")).filter(F.col("rows") >= min_rows)


# Weather segments: name -> condition on temperature, rain and humidity.
def weather_segments() -> dict[str, Column]:
    t, p, h = F.col("avg_temperature"), F.col("precpt"), F.col("avg_humidity")
    return {
        "hot": t >= 25,
        "mild": t.between(15, 25),
        "cold": t <= 15,
        "rainy": p >= 2,
        "dry": p <= 1,
        "humid": h >= 75,
        "low_humidity": h <= 50,
    }


def explode_conditions(df: DataFrame, conditions: dict[str, Column], name: str) -> DataFrame:
    """One row per matching named condition; a row may match several."""
    return df.withColumn(name, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))))


def weather_promotion_matrix(sales: DataFrame, min_rows: int = 6) -> DataFrame:
    """Promotion uplift in each weather segment with its priority."""
    p = F.col("discount") > 0
    rows = explode_conditions(sales, weather_segments(), "segment")
    g = rows.groupBy("segment").agg(
        F.count_if(p).alias("promo_rows"),
        F.count_if(~p).alias("base_rows"),
        mean_if(p, "sale_amount").alias("promo_mean"),
        mean_if(~p, "sale_amount").alias("base_mean"),
    ).filter((F.col("promo_rows") >= min_rows) & (F.col("base_rows") >= min_rows))
    g = g.withColumn("uplift_pct", ratio(F.col("promo_mean") - F.col("base_mean"), "base_mean") * 100)
    u, n = F.col("uplift_pct"), F.col("promo_rows")
    return g.withColumns(
        {
            "priority": F.when((u > 20) & (n > 20), "High Priority")
            .when((u > 10) & (n > 10), "Medium Priority")
            .when(u > 5, "Low Priority")
            .otherwise("Not Recommended"),
            "strategy": ladder("uplift_pct", [(15, "aggressive"), (8, "moderate"), (3, "light")], "operational", op=">"),
            "trigger": u > 10,
        }
    )


def weather_discount_effect(sales: DataFrame, min_rows: int = 4) -> DataFrame:
    """Mean sales and sales per discount point by weather segment and discount range."""
    d = F.col("discount") * 100
    rng = F.when(d <= 10, "up to 10%").when(d <= 20, "10-20%").when(d <= 30, "20-30%").otherwise("over 30%")
    rows = explode_conditions(sales.filter(F.col("discount") > 0), weather_segments(), "segment")
    g = rows.groupBy("segment", rng.alias("discount_range")).agg(
        F.count(F.lit(1)).alias("rows"), mean_of("sale_amount").alias("mean_sales"), mean_of("discount").alias("_d")
    ).filter(F.col("rows") >= min_rows)
    return g.withColumn("sales_per_point", F.col("mean_sales") / (F.col("_d") * 100)).drop("_d")


def weather_calendar(sales: DataFrame, matrix: DataFrame, min_rows: int = 6) -> DataFrame:
    """Typical weather of each month, its segment and the uplift known for that segment."""
    g = sales.groupBy(F.month("sale_date").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("avg_temperature").alias("mean_temp"), F.avg("precpt").alias("mean_rain")
    ).filter(F.col("rows") >= min_rows)
    temp = ladder("mean_temp", [(25, "hot")], "mild", op=">")
    seg = F.when(F.col("mean_temp") < 15, "cold").otherwise(temp)
    g = g.withColumn("segment", seg).withColumn("weather", F.when(F.col("mean_rain") > 2, F.concat("segment", F.lit("_rainy"))).otherwise(F.col("segment")))
    return g.join(matrix.select("segment", "uplift_pct"), "segment", "left")


def weather_roi(matrix: DataFrame, discount: float = 0.15) -> DataFrame:
    """Return on the discount in each segment: extra sales less discount cost, over the cost."""
    cost = F.col("promo_mean") * discount
    gain = F.col("promo_mean") - F.col("base_mean")
    return matrix.select("segment", gain.alias("extra_sales"), cost.alias("discount_cost"), (ratio(gain - cost, cost) * 100).alias("roi_pct"))


