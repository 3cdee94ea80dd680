"""Function, cleaning and feature queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import arrays, calendar, climate, codec
from ..functions.core import finite, mean_of, stable_bucket
from ..operators import cleaning, features
from .registry import corr_sql, q, query
from .series import DAILY, KEYS, _P, daily

_CAL = """(isodow({d})-1)::INT AS day_of_week, month({d})::INT AS month, quarter({d})::INT AS quarter, day({d})::INT AS day_of_month,
  week({d})::INT AS iso_week, dayofyear({d})::INT AS day_of_year, (isodow({d})>=6)::INT AS is_weekend,
  (day({d})<=5)::INT AS is_month_start, (day({d})>=25)::INT AS is_month_end"""


@query(
    "calendar_features",
    "FN-5 FN-6 FN-7 FEA-4",
    f"""
SELECT s.sale_date::VARCHAR AS sale_date, {_CAL.format(d='s.sale_date')},
  {', '.join(f"{q(f'{fn}({ph}*2*pi())')} AS {n}_{fn}" for n, ph in (('day', 'dayofyear(s.sale_date)/365.25'), ('week', 'week(s.sale_date)/52.0'), ('month', 'month(s.sale_date)/12.0')) for fn in ('sin', 'cos'))},
  CASE WHEN month(s.sale_date) IN (12,1,2) THEN 'winter' WHEN month(s.sale_date)<=5 THEN 'spring' WHEN month(s.sale_date)<=8 THEN 'summer' ELSE 'autumn' END AS season,
  coalesce(s.sale_date - (SELECT max(date) FROM holidays h WHERE h.date <= s.sale_date), 365)::INT AS days_since_holiday,
  coalesce((SELECT min(date) FROM holidays h WHERE h.date > s.sale_date) - s.sale_date, 365)::INT AS days_until_holiday
FROM sale_days s""",
)
def calendar_features(t):
    out = features.temporal_features(t.sale_days, t.sale_days, t.holidays)
    return out.withColumn("season", calendar.season(F.col("sale_date")))


_LOW, _HIGH, _WIND = (f"(SELECT {f} FROM weather)" for f in ("min(avg_temperature)", "max(avg_temperature)", "max(avg_wind_level)"))
_WI = {
    "temp_impact": "1/(1+abs(avg_temperature-22.5::DOUBLE)/10)",
    "humidity_impact": "1/(1+abs(avg_humidity-50)/20)",
    "rain_impact": "CASE WHEN precpt>0 AND precpt<=5 THEN 1.1::DOUBLE WHEN precpt>5 THEN 1-least(precpt/50, 0.5::DOUBLE) ELSE 1.0::DOUBLE END",
    "wind_impact": f"1-avg_wind_level/{_WIND}*0.2::DOUBLE",
}


@query(
    "weather_features",
    "FN-8 FN-9 FEA-1",
    f"""
, i AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _WI.items())} FROM weather)
SELECT city_id, date::VARCHAR AS date, {', '.join(f'{q(c)} AS {c}' for c in ('avg_temperature', 'avg_humidity', 'precpt', 'avg_wind_level', *_WI))},
  {q('0.4::DOUBLE*temp_impact+0.3::DOUBLE*humidity_impact+0.2::DOUBLE*rain_impact+0.1::DOUBLE*wind_impact')} AS comfort_index,
  {q(f'(avg_temperature-{_LOW})/({_HIGH}-{_LOW})*sin(month(date)*2*pi()/12)')} AS weather_seasonality,
  {q('CASE WHEN count(*) OVER w=7 THEN stddev_samp(avg_temperature) OVER w END')} AS temp_volatility,
  {q('CASE WHEN count(*) OVER w=7 THEN stddev_samp(avg_humidity) OVER w END')} AS humidity_volatility
FROM i WINDOW w AS (PARTITION BY city_id ORDER BY date ROWS 6 PRECEDING)""",
)
def weather_features(t):
    return features.weather_features(t.weather)


@query(
    "weather_labels",
    "FN-10 FN-11 FN-12 FN-9",
    f"""
SELECT city_id, date::VARCHAR AS date,
  CASE WHEN avg_temperature<=15 THEN 'Cold' WHEN avg_temperature<=22 THEN 'Mild' WHEN avg_temperature<=28 THEN 'Warm' ELSE 'Hot' END AS temperature_level,
  CASE WHEN precpt>5 THEN 'rainy' WHEN precpt<1 THEN 'dry' WHEN avg_temperature<18 THEN 'cold' WHEN avg_temperature>25 THEN 'warm' ELSE 'mild' END AS category,
  CASE WHEN precpt<=0 THEN 'none' WHEN precpt<=5 THEN 'light' WHEN precpt<=15 THEN 'moderate' ELSE 'heavy' END AS rain_class,
  {q('1-abs(avg_temperature-22.5::DOUBLE)/30')} AS comfort FROM weather""",
)
def weather_labels(t):
    temp, rain = F.col("avg_temperature"), F.col("precpt")
    return t.weather.select(
        "city_id",
        "date",
        climate.temperature_label(temp).alias("temperature_level"),
        climate.weather_category(temp, rain).alias("category"),
        climate.rain_class(rain).alias("rain_class"),
        climate.simple_comfort(temp).alias("comfort"),
    )


_CITY_CASE = "CASE city_id " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in codec.CITY_ADJUSTMENTS.items()) + " ELSE 1 END"
_GROUP_CASE = (
    "CASE management_group_id " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in codec.GROUP_MULTIPLIERS.items()) + " ELSE 20 END"
)


@query(
    "decoded_amounts",
    "FN-1 FN-2",
    f"""
, e AS (SELECT *, units_sold/10.0::DOUBLE AS enc, 20::DOUBLE*({_CITY_CASE})*(({_GROUP_CASE})/20) AS f FROM sales)
SELECT sale_date::VARCHAR AS sale_date, store_id, product_id, {q('enc*f')} AS decoded, {q('sale_amount::DOUBLE/f')} AS encoded FROM e""",
)
def decoded_amounts(t):
    city, group = F.col("city_id"), F.col("management_group_id")
    return t.sales().select(
        "sale_date",
        "store_id",
        "product_id",
        codec.decode_amount(F.col("units_sold") / 10, city, group).alias("decoded"),
        codec.encode_amount(F.col("sale_amount").cast("double"), city, group).alias("encoded"),
    )


@query(
    "hourly_metrics",
    "FN-15 FN-16 FN-17 INV-4",
    f"""
, m AS (SELECT sale_date, store_id, product_id, count(*)::INT n, sum(hour_sale) s,
   sum(hour_sale) FILTER (WHERE hour_sale>0)/nullif(count(*) FILTER (WHERE hour_sale>0),0) av, max(hour_sale) mx,
   arg_max(hour_of_day, hour_sale*100 - hour_of_day)::INT pk, (count(*) FILTER (WHERE hour_sale>0))::INT act,
   (count(*) FILTER (WHERE is_out))::INT out FROM hourly GROUP BY 1,2,3)
SELECT sale_date::VARCHAR AS sale_date, store_id, product_id, n AS hours_with_data, {q('s')} AS total_hourly_sales, {q('av')} AS avg_hourly_sales,
  {q('mx')} AS peak_hourly_sales, pk AS peak_hour, {q('mx/(s/n)')} AS peak_intensity, act AS hours_active, out AS total_stockout_hours,
  CASE WHEN pk<10 THEN 'morning' WHEN pk<15 THEN 'afternoon' ELSE 'evening' END AS part,
  CASE WHEN pk<6 THEN 'Morning_Peak' WHEN pk>12 THEN 'Evening_Peak' ELSE 'Midday_Peak' END AS pattern, {q('out::DOUBLE/n')} AS stockout_share
FROM m""",
)
def hourly_metrics(t):
    h = arrays.hourly_metrics(t.with_hours(t.lines()))
    return h.select(
        "sale_date", "store_id", "product_id", "hours_with_data", "total_hourly_sales", "avg_hourly_sales",
        "peak_hourly_sales", "peak_hour", "peak_intensity", "hours_active", "total_stockout_hours",
        arrays.shopping_part(F.col("peak_hour")).alias("part"),
        arrays.daily_pattern(F.col("peak_hour")).alias("pattern"),
        arrays.zero_share(F.col("hours_stock_status")).alias("stockout_share"),
    )


@query(
    "hourly_rows",
    "FN-18",
    f"""
SELECT store_id, hour_of_day, count(*) AS "rows", {q('sum(hour_sale)')} AS sales_amount, (count(*) FILTER (WHERE NOT is_out))::BIGINT AS available
FROM hourly GROUP BY 1,2""",
)
def hourly_rows(t):
    h = arrays.explode_hours(t.with_hours(t.lines()))
    return h.groupBy("store_id", "hour_of_day").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("sales_amount").alias("sales_amount"), F.count_if("stock_available").alias("available")
    )


@query(
    "hours_text_codec",
    "FN-3 FN-24",
    f"""
, e AS (SELECT h.sale_date, h.store_id, h.product_id, sum(CASE WHEN h.product_id%10=0 THEN 0 ELSE hour_sale END) s,
   count(*) FILTER (WHERE h.product_id%10<>0) n FROM hourly h GROUP BY 1,2,3)
SELECT e.sale_date::VARCHAR AS sale_date, e.store_id, e.product_id, e.n::INT AS slots,
  {q(f'e.s*(20::DOUBLE*({_CITY_CASE})*(({_GROUP_CASE})/20))', 3)} AS decoded_total
FROM e JOIN sales USING (sale_date, store_id, product_id)""",
    digits=3,
)
def hours_text_codec(t):
    # every tenth product carries an unreadable text, which must decode to an empty array
    s = t.with_hours(t.sales())
    text = F.when(F.col("product_id") % 10 == 0, "[broken").otherwise(F.to_json("hours_sale"))
    hours = codec.decode_hours(arrays.parse_hours(text), F.col("city_id"), F.col("management_group_id"))
    return s.select("sale_date", "store_id", "product_id", hours.alias("h")).select(
        "sale_date", "store_id", "product_id", F.size("h").alias("slots"), arrays.array_sum(F.col("h")).alias("decoded_total")
    )


@query(
    "synthetic_customers",
    "FN-20 CUS-1",
    f"""
SELECT md5(store_id || '|' || product_id || '|' || (isodow(sale_date)-1)) AS customer_key, count(*) AS visits, {q('sum(sale_amount)')} AS amount
FROM lines GROUP BY 1""",
)
def synthetic_customers(t):
    key = F.md5(F.concat_ws("|", "store_id", "product_id", F.weekday("sale_date")))
    return t.lines().groupBy(key.alias("customer_key")).agg(
        F.count(F.lit(1)).alias("visits"), F.sum("sale_amount").alias("amount")
    )


@query(
    "stable_buckets",
    "FN-25 FN-23",
    f"""
SELECT (('0x' || substr(md5(store_id || '_' || product_id), 1, 7))::BIGINT % 100)::BIGINT AS bucket, count(*) AS "rows", {q('sum(units_sold)::DOUBLE/count(*)')} AS mean_units FROM lines GROUP BY 1""",
)
def stable_buckets(t):
    b = t.lines().withColumn("bucket", stable_bucket("store_id", "product_id"))
    return b.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), finite(mean_of("units_sold")).alias("mean_units")
    )


@query(
    "conform_sales",
    "PRE-1",
    """
SELECT sale_date::VARCHAR AS sale_date, store_id, product_id, units_sold, FALSE AS activity_flag, 0::DOUBLE AS precpt,
  NULL::VARCHAR AS first_category, 22::DOUBLE AS avg_temperature FROM lines""",
)
def conform_sales(t):
    schema = (
        "sale_date date, store_id bigint, product_id bigint, units_sold bigint, activity_flag boolean, precpt double, "
        "first_category string, avg_temperature double"
    )
    return cleaning.conform(t.lines(), schema, {"avg_temperature": 22.0})


_GAP = "(dayofyear({d}) + city_id) % 7 = 0"


def _gappy(t):
    gap = (F.dayofyear("sale_date") + F.col("city_id")) % 7 == 0
    return t.sales(category=False).withColumns(
        {
            "avg_temperature": F.when(~gap, F.col("avg_temperature")),
            "discount": F.when(~gap, F.col("discount")),
        }
    )


@query(
    "impute_weather",
    "PRE-2",
    f"""
, g AS (SELECT sale_date, store_id, product_id, city_id, CASE WHEN NOT ({_GAP.format(d='sale_date')}) THEN avg_temperature END t,
   CASE WHEN NOT ({_GAP.format(d='sale_date')}) THEN discount END dc FROM sales)
SELECT sale_date::VARCHAR AS sale_date, store_id, product_id, {q('coalesce(t, avg(t) OVER (PARTITION BY city_id))')} AS avg_temperature,
  {q('coalesce(dc,0)')} AS discount FROM g""",
)
def impute_weather(t):
    out = cleaning.impute(_gappy(t))
    return out.select("sale_date", "store_id", "product_id", "avg_temperature", "discount")


@query(
    "impute_median",
    "PRE-3 AGG-9",
    f"""
, g AS (SELECT sale_date, store_id, product_id, CASE WHEN NOT ({_GAP.format(d='sale_date')}) THEN avg_temperature END t FROM sales)
SELECT sale_date::VARCHAR AS sale_date, store_id, product_id, {q('coalesce(t, (SELECT median(t) FROM g))')} AS avg_temperature FROM g""",
)
def impute_median(t):
    g = _gappy(t).select("sale_date", "store_id", "product_id", "avg_temperature")
    return cleaning.impute_overall(g, ["avg_temperature"], "median")


_FENCE = """
, f AS (SELECT quantile_cont(sale_amount::DOUBLE,0.25) q1, quantile_cont(sale_amount::DOUBLE,0.75) q3 FROM lines),
o AS (SELECT l.*, q1-1.5*(q3-q1) lo, q3+1.5*(q3-q1) hi FROM lines l, f),
x AS (SELECT *, (sale_amount::DOUBLE<lo OR sale_amount::DOUBLE>hi)::INT fl, greatest(lo, least(hi, sale_amount::DOUBLE)) cap FROM o)"""


@query(
    "outliers_and_scaling",
    "PRE-4 PRE-5 AGG-8",
    f"""{_FENCE}
SELECT sale_date::VARCHAR AS sale_date, store_id, product_id, {q('sale_amount')} AS sale_amount, fl AS is_outlier, {q('cap')} AS sale_amount_capped,
  {q('(sale_amount::DOUBLE-avg(sale_amount::DOUBLE) OVER ())/stddev_pop(sale_amount::DOUBLE) OVER ()')} AS sale_amount_scaled,
  {q('(units_sold-avg(units_sold::DOUBLE) OVER ())/stddev_pop(units_sold::DOUBLE) OVER ()')} AS units_sold_scaled FROM x""",
)
def outliers_and_scaling(t):
    base = t.lines().select("sale_date", "store_id", "product_id", "sale_amount", "units_sold")
    out = cleaning.flag_outliers(base, "sale_amount")
    return cleaning.zscale(out, ["sale_amount", "units_sold"]).drop("units_sold")


@query(
    "preprocess",
    "PRE-6 WIN-16",
    f"""
, hq AS (SELECT quantile_cont(avg_humidity,0.25) a, quantile_cont(avg_humidity,0.5) b, quantile_cont(avg_humidity,0.75) c,
   quantile_cont(avg_wind_level,0.5) w, quantile_cont(discount::DOUBLE,0.25) da, quantile_cont(discount::DOUBLE,0.5) db,
   quantile_cont(discount::DOUBLE,0.75) dc FROM sales),
l AS (SELECT s.*, CASE WHEN avg_temperature<=15 THEN 'Cold' WHEN avg_temperature<=22 THEN 'Mild' WHEN avg_temperature<=28 THEN 'Warm' ELSE 'Hot' END tl,
   CASE WHEN avg_humidity<=a THEN 'Low' WHEN avg_humidity<=b THEN 'Medium' WHEN avg_humidity<=c THEN 'High' ELSE 'Very High' END hl,
   (precpt>0)::INT r, (avg_wind_level>w)::INT wi,
   CASE WHEN discount::DOUBLE<=da THEN 'No Discount' WHEN discount::DOUBLE<=db THEN 'Low' WHEN discount::DOUBLE<=dc THEN 'Medium' ELSE 'High' END dl FROM sales s, hq)
SELECT sale_date::VARCHAR AS sale_date, store_id, product_id, (isodow(sale_date)-1)::INT AS day_of_week, tl AS temperature_level, hl AS humidity_level,
  r AS is_rainy, wi AS is_windy, dl AS discount_level,
  coalesce(nullif(concat_ws('_', CASE WHEN r=1 THEN 'Rainy' END, CASE WHEN wi=1 THEN 'Windy' END, CASE WHEN tl IN ('Cold','Hot') THEN tl END,
    CASE WHEN hl='Very High' THEN 'Humid' END), ''), 'Normal') AS weather_condition,
  {q('least(stock_hour6_22_cnt,16)/24.0')} AS stockout_risk,
  {q('(avg_humidity-avg(avg_humidity) OVER ())/stddev_pop(avg_humidity) OVER ()')} AS avg_humidity_scaled FROM l""",
)
def preprocess(t):
    out = cleaning.preprocess(t.with_hours(t.sales(category=False)))
    return out.select(
        "sale_date", "store_id", "product_id", "day_of_week", "temperature_level", "humidity_level", "is_rainy",
        "is_windy", "discount_level", "weather_condition", "stockout_risk", "avg_humidity_scaled",
    )


@query(
    "category_features",
    "FEA-2",
    f"""
, st AS (SELECT first_category, sum(sale_amount)::DOUBLE/count(*) m, stddev_samp(sale_amount::DOUBLE) s, count(*) n, min(sale_date) d0,
   CASE WHEN count(*)>10 THEN {corr_sql('sale_amount', 'discount')} ELSE 0 END c FROM sales GROUP BY 1),
dc AS (SELECT sale_date, first_category, sum(sale_amount) v FROM sales GROUP BY 1,2),
dd AS (SELECT sale_date, sum(v) t FROM dc GROUP BY 1),
mo AS (SELECT first_category, month(sale_date) mm, sum(sale_amount)::DOUBLE/count(*) ma FROM sales GROUP BY 1,2),
dv AS (SELECT store_id, count(DISTINCT first_category)::BIGINT dv FROM sales GROUP BY 1)
SELECT s.sale_date::VARCHAR AS sale_date, s.store_id, s.product_id, {q('m')} AS category_mean, {q('st.s')} AS category_std, n AS category_count,
  {q('v::DOUBLE/t::DOUBLE')} AS category_market_share, {q('ma')} AS category_monthly_avg, dv AS store_category_diversity,
  (s.sale_date-d0)::INT AS category_days_since_introduction, {q('c')} AS discount_sensitivity
FROM sales s JOIN st USING (first_category) JOIN dc ON dc.sale_date=s.sale_date AND dc.first_category=s.first_category
JOIN dd ON dd.sale_date=s.sale_date JOIN mo ON mo.first_category=s.first_category AND mo.mm=month(s.sale_date) JOIN dv ON dv.store_id=s.store_id""",
)
def category_features(t):
    sales = t.sales().select("sale_date", "store_id", "product_id", "first_category", "sale_amount", "discount")
    return features.category_features(sales).select(
        "sale_date", "store_id", "product_id", "category_mean", "category_std", "category_count", "category_market_share",
        "category_monthly_avg", "store_category_diversity", "category_days_since_introduction", "discount_sensitivity",
    )


def _mean(c, cond=None):
    f = f" FILTER (WHERE {cond})" if cond else ""
    return f"(sum({c}){f}::DOUBLE/nullif(count({c}){f},0))"


MEAN = _mean


@query(
    "store_features",
    "FEA-3 AGG-17",
    f"""
, c AS (SELECT city_id, {_mean('sale_amount')} cm, stddev_samp(sale_amount::DOUBLE) cs, count(DISTINCT store_id)::BIGINT cd FROM sales GROUP BY 1)
SELECT store_id, s.city_id, {q(_mean('sale_amount'))} AS store_mean, {q('stddev_samp(sale_amount::DOUBLE)')} AS store_std,
  {q('min(sale_amount)')} AS store_min, {q('max(sale_amount)')} AS store_max, count(*) AS store_count,
  {q('stddev_samp(sale_amount::DOUBLE)/' + _mean('sale_amount'))} AS store_sales_cv,
  {q(f"coalesce({_mean('sale_amount', 'isodow(sale_date)>=6')}/{_mean('sale_amount', 'isodow(sale_date)<6')},1)")} AS weekend_preference,
  {q('coalesce(1/(1+stddev_samp(sale_amount::DOUBLE)/' + _mean('sale_amount') + '),0.5)')} AS loyalty,
  {q(_mean('stock_hour6_22_cnt'))} AS stock_efficiency,
  {q(f"coalesce({_mean('sale_amount', 'activity_flag')}/{_mean('sale_amount', 'NOT activity_flag')},1)")} AS promo_effectiveness,
  {q('any_value(cm)')} AS city_mean, {q('any_value(cs)')} AS city_std, any_value(cd) AS city_store_density
FROM sales s JOIN c ON c.city_id=s.city_id GROUP BY 1,2""",
)
def store_features(t):
    return features.store_features(t.sales(category=False))


@query(
    "store_shopping_part",
    "FEA-3 FN-16",
    """
, m AS (SELECT sale_date, store_id, product_id, arg_max(hour_of_day, hour_sale*100 - hour_of_day) pk FROM hourly GROUP BY 1,2,3)
SELECT store_id, CASE WHEN pk<10 THEN 'morning' WHEN pk<15 THEN 'afternoon' ELSE 'evening' END AS shopping_part, count(*) AS "rows" FROM m GROUP BY 1,2""",
)
def store_shopping_part(t):
    return features.store_shopping_part(t.with_hours(t.lines()))


_AGGCAT = f"""
, cat AS (SELECT sale_date, first_category, store_id, city_id, sum(sale_amount) cs, count(*) n, sum(units_sold)::BIGINT qty, max(discount) dm,
   sum(discount)::DOUBLE/count(*) da, avg(sale_amount::DOUBLE/units_sold) pr, sum(stock_hour6_22_cnt)::DOUBLE/count(*) sh, max(holiday_flag::INT) hf,
   sum(activity_flag::INT)::DOUBLE/count(*) ps, avg(avg_temperature) tm, avg(precpt) pm FROM sales GROUP BY 1,2,3,4)"""


@query(
    "category_aggregate",
    "FEA-6 FEA-8",
    f"""{_AGGCAT}
, dt AS (SELECT sale_date, sum(cs) t FROM cat GROUP BY 1), sd AS (SELECT sale_date, store_id, sum(cs) t, count(*) k FROM cat GROUP BY 1,2)
SELECT cat.sale_date::VARCHAR AS sale_date, first_category, cat.store_id, city_id, {q('cs')} AS category_sales, n AS sale_amount_count, qty AS sale_qty_sum,
  {q('da')} AS discount_mean, {q('dm')} AS discount_max, {q('pr')} AS price_mean, {q('sh')} AS stock_hours_mean, hf AS holiday_flag, {q('ps')} AS promo_share,
  {q('tm')} AS avg_temperature_mean, {q('pm')} AS precpt_mean, {q('sd.t')} AS store_total_sales, k AS store_category_count,
  {q('cs::DOUBLE/dt.t::DOUBLE')} AS category_market_share, {q('cs::DOUBLE/sd.t::DOUBLE')} AS category_store_share
FROM cat JOIN dt ON dt.sale_date=cat.sale_date JOIN sd ON sd.sale_date=cat.sale_date AND sd.store_id=cat.store_id""",
)
def category_aggregate(t):
    out = features.category_share_columns(features.aggregate_category(t.sales()))
    return out.drop("sale_amount_mean", "sale_qty_mean", "avg_humidity_mean", "avg_wind_level_mean")


@query(
    "category_dynamics",
    "FEA-7 AGG-13",
    f"""{_AGGCAT}
, x AS (SELECT *, sale_date-(SELECT min(sale_date) FROM cat) i FROM cat)
SELECT first_category, count(*) AS "rows", {q(_mean('cs'))} AS category_velocity, {q('coalesce(stddev_samp(cs::DOUBLE)/' + _mean('cs') + ',0)')} AS category_volatility,
  {q('CASE WHEN count(*)>10 THEN regr_slope(cs::DOUBLE, i) ELSE 0 END')} AS category_trend FROM x GROUP BY 1""",
)
def category_dynamics(t):
    return features.category_dynamics(features.aggregate_category(t.sales()))


@query(
    "forecast_features",
    "FEA-10 FEA-11",
    f"""{DAILY}
SELECT city_id, first_category, sale_date::VARCHAR AS sale_date, {q('a')} AS sale_amount, (isodow(sale_date)-1)::INT AS day_of_week, month(sale_date)::INT AS month,
  quarter(sale_date)::INT AS quarter, (isodow(sale_date)>=6)::INT AS is_weekend, (sale_date-(SELECT min(sale_date) FROM d))::INT AS days_since_start,
  {', '.join(f'{q(f"coalesce(lag(a,{n}) OVER ({_P}),0)")} AS lag_{n}' for n in (1, 7, 30))},
  {', '.join(f'{q(f"coalesce(CASE WHEN count(*) OVER ({_P} ROWS {n - 1} PRECEDING)={n} THEN sum(a) OVER ({_P} ROWS {n - 1} PRECEDING)::DOUBLE/{n} END,0)")} AS roll_mean_{n}' for n in (7, 30))},
  {q(f"coalesce(CASE WHEN count(*) OVER ({_P} ROWS 13 PRECEDING)=14 THEN sum(a) OVER ({_P} ROWS 6 PRECEDING)::DOUBLE/7 - sum(a) OVER ({_P} ROWS 13 PRECEDING)::DOUBLE/14 END,0)")} AS roll_gap
FROM d""",
)
def forecast_features(t):
    return features.forecast_features(daily(t), KEYS)


@query(
    "weather_model_features",
    "FEA-9 FEA-11",
    f"""
, d AS (SELECT city_id, sale_date, sum(units_sold)::BIGINT u FROM sales GROUP BY 1,2),
n AS (SELECT city_id, month(date) m, avg(avg_temperature) nm FROM weather GROUP BY 1,2)
SELECT d.city_id, d.sale_date::VARCHAR AS sale_date, u AS units_sold, lag(u,1) OVER w AS lag_1, lag(u,7) OVER w AS lag_7,
  {q('CASE WHEN count(u) OVER (PARTITION BY d.city_id ORDER BY sale_date ROWS 6 PRECEDING)=7 THEN sum(u) OVER (PARTITION BY d.city_id ORDER BY sale_date ROWS 6 PRECEDING)::DOUBLE/7 END')} AS roll_mean_7,
  {q('avg_temperature*avg_humidity/100')} AS temp_humidity, {q('avg_temperature*precpt')} AS temp_rain, {q('avg_wind_level*precpt')} AS wind_rain,
  {q('avg_temperature-nm')} AS temp_deviation, {q(_WI['temp_impact'])} AS temp_impact
FROM d JOIN weather we ON we.city_id=d.city_id AND we.date=d.sale_date JOIN n ON n.city_id=d.city_id AND n.m=month(d.sale_date)
WINDOW w AS (PARTITION BY d.city_id ORDER BY sale_date)""",
)
def weather_model_features(t):
    d = t.daily("city_id", category=False).select("city_id", "sale_date", "units_sold")
    return features.weather_model_features(d, t.weather).select(
        "city_id", "sale_date", "units_sold", "lag_1", "lag_7", "roll_mean_7", "temp_humidity", "temp_rain", "wind_rain",
        "temp_deviation", "temp_impact",
    )


@query(
    "demand_features",
    "FEA-11 WIN-7",
    f"""
, d AS (SELECT city_id, sale_date, sum(units_sold)::BIGINT u, max(stock_hour6_22_cnt) sh FROM sales GROUP BY 1,2)
SELECT d.city_id, d.sale_date::VARCHAR AS sale_date, u AS units_sold, lag(u,30) OVER (PARTITION BY d.city_id ORDER BY sale_date) AS lag_30,
  {q('sum(u) OVER (PARTITION BY d.city_id ORDER BY sale_date ROWS 29 PRECEDING)::DOUBLE/count(*) OVER (PARTITION BY d.city_id ORDER BY sale_date ROWS 29 PRECEDING)')} AS roll_mean_30,
  {q('avg_temperature*avg_humidity')} AS temp_humidity, {q('avg_temperature*precpt')} AS temp_rain, {q('sh/16.0')} AS stockout_impact
FROM d LEFT JOIN weather we ON we.city_id=d.city_id AND we.date=d.sale_date""",
)
def demand_features(t):
    d = t.daily("city_id", category=False).select("city_id", "sale_date", "units_sold", "stock_hours")
    return features.demand_features(d, t.weather, ["city_id"]).select(
        "city_id", "sale_date", "units_sold", "lag_30", "roll_mean_30", "temp_humidity", "temp_rain", "stockout_impact"
    )


@query(
    "future_frame",
    "FEA-12",
    f"""{DAILY}
, r AS (SELECT *, row_number() OVER (PARTITION BY city_id, first_category ORDER BY sale_date DESC) rn FROM d),
l AS (SELECT city_id, first_category, max(sale_date) ld, sum(u) FILTER (WHERE rn<=30)::DOUBLE/count(*) FILTER (WHERE rn<=30) m30,
  sum(u) FILTER (WHERE rn<=7)::DOUBLE/count(*) FILTER (WHERE rn<=7) m7, max(u) FILTER (WHERE rn=1) l1, max(u) FILTER (WHERE rn=7) l7, max(u) FILTER (WHERE rn=30) l30
  FROM r GROUP BY 1,2)
SELECT city_id, first_category, (ld+h.i::INT)::VARCHAR AS sale_date, {q('m30')} AS mean_30, {q('m7')} AS mean_7, l1 AS lag_1, l7 AS lag_7, l30 AS lag_30,
  (isodow(ld+h.i::INT)-1)::INT AS day_of_week, month(ld+h.i::INT)::INT AS month FROM l, range(1,15) h(i)""",
)
def future_frame(t):
    d = t.daily(*KEYS).select(*KEYS, "sale_date", "units_sold", "discount")
    return features.future_frame(d, KEYS, 14).select(
        *KEYS, "sale_date", "mean_30", "mean_7", "lag_1", "lag_7", "lag_30", "day_of_week", "month"
    )


@query(
    "store_vector",
    "FEA-13",
    f"""
, mm AS (SELECT store_id, month(sale_date) m, {_mean('sale_amount')} a FROM sales GROUP BY 1,2),
se AS (SELECT store_id, stddev_samp(a) sv, arg_max(m, a)::INT pm FROM mm GROUP BY 1),
tot AS (SELECT city_id, sum(sale_amount) ct FROM sales GROUP BY 1)
SELECT s.store_id, s.city_id, {q('sum(sale_amount)')} AS total_sales, {q('stddev_samp(units_sold::DOUBLE)')} AS std_units,
  {q('avg(sale_amount::DOUBLE/units_sold)')} AS mean_price,
  {q('(count(*) FILTER (WHERE stock_hour6_22_cnt>0))::DOUBLE/count(*)')} AS stockout_rate, count(DISTINCT product_id) AS products,
  {q('sum(units_sold)::DOUBLE/sum(stock_level)')} AS turnover, {q(_mean('sale_amount', 'activity_flag') + '/' + _mean('sale_amount', 'NOT activity_flag'))} AS promo_uplift,
  {q(corr_sql('sale_amount', 'avg_temperature'))} AS temp_corr, {q('any_value(sv)')} AS seasonal_variation, any_value(pm) AS peak_month,
  {q('sum(sale_amount)::DOUBLE/any_value(ct)::DOUBLE')} AS city_market_share
FROM sales s JOIN se ON se.store_id=s.store_id JOIN tot ON tot.city_id=s.city_id GROUP BY 1,2""",
)
def store_vector(t):
    s = t.sales()
    return features.store_vector(s, t.with_hours(t.lines())).select(
        "store_id", "city_id", "total_sales", "std_units", "mean_price", "stockout_rate", "products", "turnover", "promo_uplift",
        "temp_corr", "seasonal_variation", "peak_month", "city_market_share",
    )


@query(
    "product_vector",
    "FEA-14 AGG-11 JN-4",
    f"""
, b AS (SELECT product_id, sum(sale_amount) ta, {_mean('sale_amount')} ma, (count(*) FILTER (WHERE stock_hour6_22_cnt>0))::DOUBLE/count(*) so,
   coalesce({corr_sql('sale_amount', 'avg_temperature')},0) tc, coalesce({_mean('sale_amount', 'discount>0')}/{_mean('sale_amount', 'discount=0')},1) dr,
   {_mean('discount')} md FROM sales GROUP BY 1),
dd AS (SELECT product_id, sale_date, sum(units_sold)::BIGINT u FROM sales GROUP BY 1,2),
c AS (SELECT product_id, count(*) n, coalesce(stddev_samp(u::DOUBLE)/{_mean('u')},0) cv FROM dd GROUP BY 1)
SELECT product_id, {q('ta')} AS total_amount, {q('ma')} AS mean_amount, n AS active_days, {q('cv')} AS demand_cv, {q('0')} AS zero_ratio,
  {q('so')} AS stockout_rate, {q('tc')} AS temp_corr, {q('dr')} AS discount_response, {q('md')} AS mean_discount FROM b JOIN c USING (product_id)""",
)
def product_vector(t):
    return features.entity_vector(t.sales(category=False), "product_id").drop("humidity_corr", "rain_corr")
