"""Weather sensitivity, elasticity, seasons, extremes, scenarios, risk and climate trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import season
from ..functions.climate import rain_class, simple_comfort, weather_category
from ..functions.core import ladder, mean_if, mean_of, ratio, safe_corr, slope_of, std_of
from .promotions import explode_conditions
from .ranking import exact_quantiles
from .series import equal_width_bins, longest_run

FACTORS = ("avg_temperature", "avg_humidity", "precpt", "avg_wind_level")


def sensitivity_by_bin(sales: DataFrame, factor: str, bins: int) -> DataFrame:
    """Mean, deviation and rows of sales by equal-width bin of a factor; the best bin is marked."""
    b = equal_width_bins(sales, factor, bins)
    return _with_best(_bin_stats(b, "bin"), "bin")


def sensitivity_by_rain(sales: DataFrame) -> DataFrame:
    return _with_best(_bin_stats(sales.withColumn("bin", rain_class(F.col("precpt"))), "bin"), "bin")


def _bin_stats(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(
        mean_of("sale_amount").alias("mean_sales"), std_of("sale_amount").alias("std_sales"), F.count(F.lit(1)).alias("rows")
    )


def _with_best(stats: DataFrame, by: str) -> DataFrame:
    best = stats.agg(F.max("mean_sales")).scalar()
    return stats.withColumn("is_optimal", F.col("mean_sales") == best)


def elasticity(daily: DataFrame, keys: Sequence[str], value: str = "sale_amount", factors: Sequence[str] = FACTORS) -> DataFrame:
    """Elasticity from relative changes day to day: sd(dy)/sd(dx)*r and r alone, with a class, per key and factor.

    ``daily`` has one row per key and day with the weather of that day.
    """
    w = W.partitionBy(*keys).orderBy("sale_date")
    x = daily.withColumn("_dy", ratio(F.col(value) - F.lag(value).over(w), F.lag(value).over(w)))
    x = x.withColumns({f"_d_{f}": ratio(F.col(f) - F.lag(f).over(w), F.lag(f).over(w)) for f in factors})
    aggs = []
    for f in factors:
        both = F.col("_dy").isNotNull() & F.col(f"_d_{f}").isNotNull()
        dy, dx = F.when(both, F.col("_dy")), F.when(both, F.col(f"_d_{f}"))
        r = safe_corr("_dy", f"_d_{f}")
        aggs.append(
            F.struct(
                F.lit(f).alias("factor"),
                F.coalesce(F.try_divide(F.stddev_samp(dy), F.stddev_samp(dx)) * r, F.lit(0.0)).alias("elasticity"),
                F.coalesce(r, F.lit(0.0)).alias("change_corr"),
            ).alias(f"_s_{f}")
        )
    g = x.groupBy(*keys).agg(*aggs)
    long = g.select(*keys, F.explode(F.array(*[F.col(f"_s_{f}") for f in factors])).alias("s")).select(*keys, "s.*")
    return long.withColumn("class", elasticity_class(F.abs("change_corr")))


def elasticity_class(a: Column) -> Column:
    return ladder(a, [(1, "highly_elastic"), (0.5, "moderately_elastic"), (0.1, "slightly_elastic")], "inelastic", op=">")


def overall_elasticity_class(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class of each key from its largest |r| over the factors."""
    g = long.groupBy(*keys).agg(
        F.max(F.abs("change_corr")).alias("max_abs"), F.max_by("factor", F.struct(F.abs("change_corr"), "factor")).alias("main_factor")
    )
    return g.withColumn("class", elasticity_class(F.col("max_abs")))


def seasonal_patterns(sales: DataFrame, keys: Sequence[str] = (), by_year: bool = False) -> DataFrame:
    """Sales, weather, stock-outs and temperature link by season (and year)."""
    time = [season(F.col("sale_date")).alias("season")] + ([F.year("sale_date").alias("year")] if by_year else [])
    return sales.groupBy(*keys, *time).agg(
        F.count(F.lit(1)).alias("rows"),
        mean_of("sale_amount").alias("avg_sales"),
        std_of("sale_amount").alias("std_sales"),
        F.avg("avg_temperature").alias("avg_temperature"),
        F.avg("avg_humidity").alias("avg_humidity"),
        F.avg("precpt").alias("avg_precipitation"),
        ratio(F.count_if(F.col("stock_hour6_22_cnt") > 0), F.count(F.lit(1))).alias("stockout_rate"),
        safe_corr("sale_amount", "avg_temperature").alias("temp_corr"),
    )


def optimal_conditions(sales: DataFrame) -> DataFrame:
    """Quartiles and means of the weather among the top quarter of sales, and their sales against all."""
    cut = exact_quantiles(sales, "sale_amount", {"v": 0.75}).select("v").scalar()
    top = sales.withColumn("_cut", cut).filter(F.col("sale_amount").cast("double") >= F.col("_cut"))
    overall = sales.agg(mean_of("sale_amount")).scalar()
    long = top.unpivot([], ["avg_temperature", "avg_humidity", "precpt"], "factor", "value")
    q = exact_quantiles(long, "value", {"q25": 0.25, "q75": 0.75}, ["factor"])
    m = long.groupBy("factor").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("rows"))
    gain = top.agg(mean_of("sale_amount")).scalar()
    return q.join(m, "factor").withColumn("sales_vs_overall_pct", (gain / overall - 1) * 100)


def extreme_impact(sales: DataFrame) -> DataFrame:
    """Sales change on hot, cold and heavy-rain days against ordinary ones, in percent."""
    long = sales.unpivot([], ["avg_temperature", "precpt"], "factor", "value")
    q = exact_quantiles(long, "value", {"q05": 0.05, "q90": 0.90, "q95": 0.95}, ["factor"])
    cut = q.agg(
        F.struct(
            F.max(F.when(F.col("factor") == "avg_temperature", F.col("q95"))).alias("hot"),
            F.max(F.when(F.col("factor") == "avg_temperature", F.col("q05"))).alias("cold"),
            F.max(F.when(F.col("factor") == "precpt", F.col("q90"))).alias("rain"),
        )
    ).scalar()
    s = sales.withColumn("_c", cut)
    t, p = F.col("avg_temperature"), F.col("precpt")
    normal = (t > F.col("_c.cold")) & (t < F.col("_c.hot"))
    a = "sale_amount"
    change = lambda x, y: (ratio(mean_if(x, a), mean_if(y, a)) - 1) * 100
    return s.agg(
        change(t >= F.col("_c.hot"), normal).alias("extreme_heat_pct"),
        change(t <= F.col("_c.cold"), normal).alias("extreme_cold_pct"),
        change(p > F.col("_c.rain"), p == 0).alias("heavy_rain_pct"),
    )


def scenario_conditions(heat: float = 35, cold: float = 0, rain: float = 20, humid: float = 90) -> dict[str, Column]:
    """Named weather scenarios; they may overlap."""
    t, h, p = F.col("avg_temperature"), F.col("avg_humidity"), F.col("precpt")
    return {
        "extreme_heat": t >= heat,
        "extreme_cold": t <= cold,
        "heavy_rain": p >= rain,
        "drought": p <= 0.1,
        "high_humidity": h >= humid,
        "perfect_weather": t.between(20, 26) & h.between(40, 60) & (p <= 2),
    }


def scenario_impacts(sales: DataFrame, conditions: dict[str, Column] | None = None, min_rows: int = 6) -> DataFrame:
    """Rows, mean sales and change against the overall mean in each scenario, with a risk label."""
    base = sales.agg(mean_of("sale_amount")).scalar()
    rows = explode_conditions(sales, conditions or scenario_conditions(), "scenario")
    g = rows.groupBy("scenario").agg(F.count(F.lit(1)).alias("frequency"), mean_of("sale_amount").alias("avg_sales"))
    g = g.filter(F.col("frequency") >= min_rows).withColumn("baseline_sales", base)
    g = g.withColumn("impact_pct", ratio(F.col("avg_sales") - F.col("baseline_sales"), "baseline_sales") * 100)
    return g.withColumn("risk_level", ladder(F.abs("impact_pct"), [(20, "high"), (10, "medium")], "low", op=">"))


def linear_what_if(sales: DataFrame, forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sales adjusted to a given weather forecast by the historical correlations, with an uncertainty band.

    ``forecast`` has the keys, ``date`` and the weather of each coming day.
    """
    t = "avg_temperature"
    g = sales.groupBy(*keys).agg(
        mean_of("sale_amount").alias("_base"),
        F.coalesce(safe_corr("sale_amount", t), F.lit(0.0)).alias("_rt"),
        F.coalesce(safe_corr("sale_amount", "avg_humidity"), F.lit(0.0)).alias("_rh"),
        F.coalesce(safe_corr("sale_amount", "precpt"), F.lit(0.0)).alias("_rp"),
        F.avg(t).alias("_t"),
        F.stddev_samp(t).alias("_ts"),
        F.avg("avg_humidity").alias("_h"),
    )
    j = forecast.join(g, list(keys))
    adj_t = F.col("_rt") * (F.col(t) - F.col("_t")) * 0.1
    adj_h = F.col("_rh") * (F.col("avg_humidity") - F.col("_h")) / 100
    adj_p = F.col("_rp") * F.col("precpt") * 0.05
    raw = F.col("_base") * (1 + adj_t) * (1 + adj_h) * (1 + adj_p)
    unc = F.when(F.abs(F.col(t) - F.col("_t")) > F.col("_ts"), 0.25).otherwise(0.15)
    return j.withColumns({"_raw": raw, "_u": unc}).select(
        *keys,
        "date",
        F.greatest(F.lit(0.0), F.col("_raw")).alias("predicted_sales"),
        F.greatest(F.lit(0.0), F.col("_raw") * (1 - F.col("_u"))).alias("lower"),
        (F.col("_raw") * (1 + F.col("_u"))).alias("upper"),
        (F.col("_rt") * F.col("_base") * 0.01).alias("impact_per_degree"),
    )


def volatility(weather: DataFrame, keys: Sequence[str] = ("city_id",)) -> DataFrame:
    """Deviation, variation, extreme days, dry spell and flood indicator per city."""
    q = exact_quantiles(weather, "avg_temperature", {"q05": 0.05, "q95": 0.95}, keys)
    rain = exact_quantiles(weather, "precpt", {"flood_q99": 0.99}, keys)
    spell = longest_run(weather, keys, F.col("precpt") < 1, "date", "dry_spell")
    j = weather.join(q, list(keys))
    t, p, h = F.col("avg_temperature"), F.col("precpt"), F.col("avg_humidity")
    g = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        F.stddev_samp(t).alias("temp_std"),
        (F.try_divide(F.stddev_samp(t), F.avg(t)) * 100).alias("temp_cv"),
        F.count_if(t > F.col("q95")).alias("hot_days"),
        F.count_if(t < F.col("q05")).alias("cold_days"),
        F.count_if(p > 10).alias("heavy_rain_days"),
        F.count_if(h > 90).alias("humid_days"),
        F.count_if(h < 30).alias("dry_air_days"),
    )
    g = g.join(rain, list(keys)).join(spell, list(keys))
    extreme = F.col("hot_days") + F.col("cold_days") + F.col("heavy_rain_days")
    score = (
        F.when(F.col("temp_cv") > 20, 2).otherwise(0)
        + F.when(extreme > F.col("days") * 0.1, 3).otherwise(0)
        + F.when(F.col("flood_q99") > 20, 2).otherwise(0)
    )
    return g.withColumn("risk_score", score).withColumn(
        "risk_class", ladder("risk_score", [(5, "High Risk"), (3, "Medium Risk")], "Low Risk")
    )


def revenue_at_risk(sales: DataFrame, horizon: int = 30, unit_price: float = 100.0) -> DataFrame:
    """Probability, sales effect and revenue at risk of heat, cold and heavy rain over the horizon."""
    rain_cut = exact_quantiles(sales, "precpt", {"v": 0.95}).select("v").scalar()
    t = F.col("avg_temperature")
    stats = sales.agg(
        F.struct(
            F.avg(t).alias("m"),
            F.stddev_samp(t).alias("s"),
            F.coalesce(safe_corr("sale_amount", "avg_temperature"), F.lit(0.0)).alias("rt"),
            F.coalesce(safe_corr("sale_amount", "precpt"), F.lit(0.0)).alias("rp"),
            mean_of("sale_amount").alias("base"),
        )
    ).scalar()
    s = sales.withColumn("_s", stats)
    share = lambda c: ratio(F.count_if(c), F.count(F.lit(1))) * 100
    probs = s.agg(
        F.first("_s").alias("_s"),
        share(t > F.col("_s.m") + 2 * F.col("_s.s")).alias("_hot"),
        share(t < F.col("_s.m") - 2 * F.col("_s.s")).alias("_cold"),
    ).withColumn("_rain", rain_cut)
    effect = F.col("_s.rt") * 2 * F.col("_s.s") * 0.1
    rows = F.array(
        F.struct(F.lit("extreme_heat").alias("scenario"), F.col("_hot").alias("probability"), effect.alias("sales_impact")),
        F.struct(F.lit("extreme_cold").alias("scenario"), F.col("_cold").alias("probability"), (-effect).alias("sales_impact")),
        F.struct(
            F.lit("heavy_precipitation").alias("scenario"),
            F.lit(5.0).alias("probability"),
            (F.col("_s.rp") * F.col("_rain") * 0.1).alias("sales_impact"),
        ),
    )
    out = probs.select(F.col("_s.base").alias("_b"), F.explode(rows).alias("r")).select("_b", "r.*")
    days = F.lit(float(horizon)) * F.col("probability") / 100
    daily = F.col("_b") * unit_price * F.abs("sales_impact")
    return out.select(
        "scenario",
        "probability",
        "sales_impact",
        daily.alias("daily_revenue_impact"),
        days.alias("expected_days"),
        (days * daily).alias("revenue_at_risk"),
    )


def climate_trend(weather: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Slope of yearly means of temperature and rain, direction, significance, last against first year."""
    y = weather.groupBy(*keys, F.year("date").alias("year")).agg(F.avg("avg_temperature").alias("temp"), F.avg("precpt").alias("rain"))
    g = y.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("years"),
        slope_of("temp", "year").alias("temp_slope"),
        slope_of("rain", "year").alias("rain_slope"),
        (F.max_by("temp", "year") - F.min_by("temp", "year")).alias("temp_change"),
    ).filter(F.col("years") > 1)
    return g.withColumns(
        {
            "temp_direction": F.when(F.col("temp_slope") > 0, "warming").otherwise("cooling"),
            "temp_significance": F.when(F.abs("temp_slope") > 0.1, "significant").otherwise("minimal"),
            "rain_direction": F.when(F.col("rain_slope") > 0, "increasing").otherwise("decreasing"),
        }
    )


# Shift in degrees and factor on rain of each climate scenario.
CLIMATE_SCENARIOS = (("current", 0.0, 1.0), ("warmer", 2.0, 0.95), ("more_volatile", 0.5, 1.2))


def climate_projection(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean sales under each climate scenario from the historical temperature and rain links."""
    g = sales.groupBy(*keys).agg(
        mean_of("sale_amount").alias("baseline"),
        F.avg("avg_temperature").alias("_t"),
        F.avg("precpt").alias("_p"),
        F.coalesce(safe_corr("sale_amount", "avg_temperature"), F.lit(0.0)).alias("_rt"),
        F.coalesce(safe_corr("sale_amount", "precpt"), F.lit(0.0)).alias("_rp"),
    )
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(s).alias("dt"), F.lit(f).alias("fp")) for n, s, f in CLIMATE_SCENARIOS]))
    j = g.select("*", rows.alias("s")).select("*", "s.*")
    effect = F.col("_rt") * F.col("dt") * 0.1 + F.col("_rp") * (F.col("_p") * F.col("fp") - F.col("_p")) * 0.05
    return j.select(
        *keys,
        "scenario",
        (F.col("_t") + F.col("dt")).alias("temperature"),
        (F.col("_p") * F.col("fp")).alias("precipitation"),
        "baseline",
        (F.col("baseline") * (1 + effect)).alias("projected_sales"),
        (effect * 100).alias("impact_pct"),
    )


def condition_effects(sales: DataFrame, keys: Sequence[str], min_rows: int = 3) -> DataFrame:
    """Mean sales by temperature and rain class per key, with place from best and from worst."""
    t, p = F.col("avg_temperature"), F.col("precpt")
    temp = F.when(t < 18, "cold").when(t > 25, "warm").otherwise("mild")
    rain = F.when(p > 5, "rainy").when(p < 1, "dry").otherwise("normal")
    g = sales.groupBy(*keys, temp.alias("temp_class"), rain.alias("rain_class")).agg(
        F.count(F.lit(1)).alias("rows"), mean_of("sale_amount").alias("avg_sales")
    ).filter(F.col("rows") >= min_rows)
    w = W.partitionBy(*keys)
    tie = ["temp_class", "rain_class"]
    return g.withColumns(
        {
            "best_place": F.row_number().over(w.orderBy(F.desc("avg_sales"), *tie)),
            "worst_place": F.row_number().over(w.orderBy("avg_sales", *tie)),
            "mean_of_conditions": F.avg("avg_sales").over(w),
            "sensitivity": F.try_divide(F.stddev_samp("avg_sales").over(w), F.avg("avg_sales").over(w)),
        }
    )


def weather_advice(effects: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stock advice where the current conditions are among the two best or two worst of a key.

    ``current`` has the keys with temp_class and rain_class of today.
    """
    j = effects.join(current, [*keys, "temp_class", "rain_class"])
    pct = (F.col("avg_sales") / F.col("mean_of_conditions") - 1) * 100
    best, worst = F.col("best_place") <= 2, F.col("worst_place") <= 2
    kind = F.when(best, "increase_stock").when(worst, "decrease_stock").otherwise("normal")
    impact = F.when(best, F.least(F.lit(50.0), pct)).when(worst, F.greatest(F.lit(-30.0), pct)).otherwise(0.0)
    out = j.withColumns({"recommendation": kind, "impact_pct": impact})
    return out.select(
        *keys,
        "temp_class",
        "rain_class",
        "recommendation",
        "impact_pct",
        F.when(best, F.least(F.lit(0.9), 0.5 + F.coalesce("sensitivity", F.lit(0.0)))).otherwise(0.5).alias("confidence"),
        F.when(best, 1 + F.col("impact_pct") / 100).when(worst, 1 - F.abs("impact_pct") / 100).otherwise(1.0).alias("weather_boost"),
        F.when(best, F.greatest(F.lit(10), (F.col("impact_pct") * 2).cast("int")))
        .when(worst, F.greatest(F.lit(-20), (F.col("impact_pct") * 2).cast("int")))
        .otherwise(0)
        .alias("stock_adjustment"),
    )


# fixed values: rule, products, measured value, direction, bound, impact in percent, stock adjustment; first match counts
WEATHER_RULES = (
    ("cold_weather_boost", (306, 413, 109), "temperature", "below", 20.0, 15.0, 20),
    ("rainy_weather_boost", (306, 413), "precipitation", "above", 4.0, 20.0, 25),
    ("warm_weather_boost", (118, 368), "temperature", "above", 24.0, 12.0, 15),
    ("high_humidity_boost", (306, 413), "humidity", "above", 80.0, 18.0, 22),
)
# fixed values: bundle, weather, products, discount, expected boost
WEATHER_BUNDLES = (
    ("cold_weather_bundle", "cold", (306, 413, 109), 0.15, 0.25),
    ("rainy_day_bundle", "rainy", (306, 413), 0.15, 0.25),
    ("warm_weather_bundle", "warm", (118, 368), 0.15, 0.25),
)
# fixed values: weather, season, expected impact in percent from and to
SEASONS = (("cold", "winter", 10, 20), ("warm", "summer", 15, 25), ("rainy", "rainy", 12, 18))


def rule_advice(current: DataFrame, rules=WEATHER_RULES) -> DataFrame:
    """Stock advice by a rule table: for every city and listed product the first rule its weather fulfils.

    ``current`` has city_id, temperature, precipitation and humidity of today.
    """
    row = "struct<place:int,rule:string,product_id:bigint,value:string,direction:string,bound:double,impact_pct:double,stock_adjustment:int>"
    listed = [
        F.struct(*[F.lit(x) for x in (i, rule, p, value, direction, bound, impact, adjust)]).cast(row)
        for i, (rule, products, value, direction, bound, impact, adjust) in enumerate(rules)
        for p in products
    ]
    each = current.withColumn("r", F.explode(F.array(*listed)))
    seen = F.when(F.col("r.value") == "temperature", F.col("temperature")).when(F.col("r.value") == "humidity", F.col("humidity")).otherwise(F.col("precipitation"))
    holds = F.when(F.col("r.direction") == "above", seen > F.col("r.bound")).otherwise(seen < F.col("r.bound"))
    first = each.filter(holds).groupBy("city_id", F.col("r.product_id").alias("product_id")).agg(F.min("r").alias("r"))
    return first.select("city_id", "product_id", "r.rule", "r.impact_pct", "r.stock_adjustment")


def bundle_advice(current: DataFrame, sold: DataFrame, bundles=WEATHER_BUNDLES) -> DataFrame:
    """Bundles that suit the weather class of a city and of which it sells at least two products."""
    row = "struct<bundle:string,weather:string,product_id:bigint,discount:double,expected_boost:double>"
    listed = [F.struct(*[F.lit(x) for x in (b, w, p, d, e)]).cast(row) for b, w, products, d, e in bundles for p in products]
    each = current.withColumn("r", F.explode(F.array(*listed))).filter(F.col("r.weather") == F.col("weather_category"))
    here = each.select("city_id", "r.*").join(sold.select("city_id", "product_id").distinct(), ["city_id", "product_id"], "left_semi")
    g = here.groupBy("city_id", "bundle", "discount", "expected_boost").agg(F.count(F.lit(1)).alias("products"))
    return g.filter(F.col("products") >= 2)


def season_advice(current: DataFrame, seasons=SEASONS) -> DataFrame:
    """Season of a city's weather class with the expected change in percent."""
    listed = [F.struct(*[F.lit(x) for x in s]).cast("struct<weather:string,season:string,impact_from:int,impact_to:int>") for s in seasons]
    each = current.withColumn("r", F.explode(F.array(*listed))).filter(F.col("r.weather") == F.col("weather_category"))
    return each.select("city_id", "r.season", "r.impact_from", "r.impact_to")


def city_climatology(weather: DataFrame, city: DataFrame) -> DataFrame:
    """Mean weather of every city; a city without records gets the overall means."""
    cols = {"temperature": "avg_temperature", "precipitation": "precpt", "humidity": "avg_humidity", "wind_level": "avg_wind_level"}
    per = weather.groupBy("city_id").agg(*[F.avg(c).alias(n) for n, c in cols.items()])
    overall = weather.agg(F.struct(*[F.avg(c).alias(n) for n, c in cols.items()])).scalar()
    j = city.select("city_id").join(per, "city_id", "left").withColumn("_o", overall)
    out = j.withColumns({n: F.coalesce(F.col(n), F.col(f"_o.{n}")) for n in cols}).drop("_o")
    return out.withColumn("weather_category", weather_category(F.col("temperature"), F.col("precipitation")))


def similar_conditions(
    sales: DataFrame, keys: Sequence[str], temperature: float, humidity: float, temp_tol: float = 5, humidity_tol: float = 20
) -> DataFrame:
    """Mean sales on days near the given conditions against all days, with a confidence by sample size."""
    near = (F.abs(F.col("avg_temperature") - temperature) <= temp_tol) & (F.abs(F.col("avg_humidity") - humidity) <= humidity_tol)
    g = sales.groupBy(*keys).agg(
        mean_of("sale_amount").alias("baseline_sales"), mean_if(near, "sale_amount").alias("_p"), F.count_if(near).alias("_n")
    )
    pred = F.coalesce("_p", F.col("baseline_sales"))
    return g.select(
        *keys,
        "baseline_sales",
        pred.alias("predicted_sales"),
        ((pred - F.col("baseline_sales")) / F.col("baseline_sales") * 100).alias("impact_pct"),
        F.when(F.col("_n") > 0, F.least(F.col("_n") / 20, F.lit(1.0))).otherwise(0.1).alias("confidence"),
    )


def weather_base(sales: DataFrame) -> DataFrame:
    """Sales with calendar, season, interaction, squared, comfort and rain flags."""
    t, h, p = F.col("avg_temperature"), F.col("avg_humidity"), F.col("precpt")
    d = F.col("sale_date")
    return sales.withColumns(
        {
            "season": season(d),
            "day_of_week": F.weekday(d),
            "month": F.month(d),
            "temp_humidity": t * h / 100,
            "temp_squared": t * t,
            "comfort": simple_comfort(t),
            "is_rainy": p > 0.1,
            "is_heavy_rain": p > 10,
        }
    )
