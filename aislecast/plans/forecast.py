"""Forecast, uplift and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features
from ..operators import forecast as fc
from ..operators import uplift as up
from .features import MEAN
from .registry import corr_sql, q, query
from .series import DAILY, KEYS, daily

_TAIL = f"""{DAILY}
, r AS (SELECT *, row_number() OVER (PARTITION BY city_id, first_category ORDER BY sale_date DESC) dn FROM d),
ts AS (SELECT city_id, first_category, {MEAN('a', 'dn<=30')} m, coalesce(stddev_samp(a::DOUBLE) FILTER (WHERE dn<=30),0) s, count(*) FILTER (WHERE dn<=30) n, max(sale_date) ld FROM r GROUP BY 1,2)"""
_NAIVE = f"""{_TAIL}
, nf AS (SELECT city_id, first_category, (ld+h.i::INT) dt, m*CASE WHEN isodow(ld+h.i::INT)>=6 THEN 0.8::DOUBLE ELSE 1 END p, s FROM ts, range(1,15) h(i)),
naive AS (SELECT city_id, first_category, dt, p f, greatest(0,p-1.96*s) lo, p+1.96*s hi FROM nf)"""


def _naive(t):
    return fc.naive_forecast(daily(t), KEYS, 14)


@query(
    "naive_forecast",
    "FC-1 FC-12",
    f"""{_NAIVE}
SELECT city_id, first_category, dt::VARCHAR AS date, {q('f')} AS forecast, {q('lo')} AS lower, {q('hi')} AS upper FROM naive""",
)
def naive_forecast(t):
    return _naive(t)


@query(
    "interval_table",
    "FC-12",
    f"""{_TAIL}
SELECT city_id, first_category, {q('m')} AS mean, {q('s')} AS std, n AS "rows", ld::VARCHAR AS last_date, lv AS level, {q('greatest(0,m-z*s)')} AS lower, {q('m+z*s')} AS upper
FROM ts, (VALUES ('80',1.28::DOUBLE),('95',1.96),('99',2.58)) z(lv,z)""",
)
def interval_table(t):
    return fc.interval_table(fc.tail_stats(daily(t), KEYS, "sale_amount", 30))


_WEEK = f"""
, r7 AS (SELECT city_id, first_category, {MEAN('a', 'dn<=7')} m, coalesce(stddev_samp(a::DOUBLE) FILTER (WHERE dn<=7),0) s, max(sale_date) ld FROM r GROUP BY 1,2),
n7 AS (SELECT city_id, first_category, (ld+h.i::INT) dt, m p, s FROM r7, range(1,15) h(i))"""


@query(
    "ensemble_forecast",
    "FC-4",
    f"""{_NAIVE}{_WEEK}
SELECT a.city_id, a.first_category, a.dt::VARCHAR AS date, {q('0.6*f+0.4*p')} AS forecast, {q('0.6*lo+0.4*greatest(0,p-1.96*n7.s)')} AS lower, {q('0.6*hi+0.4*(p+1.96*n7.s)')} AS upper
FROM naive a JOIN n7 ON n7.city_id=a.city_id AND n7.first_category=a.first_category AND n7.dt=a.dt""",
)
def ensemble_forecast(t):
    short = fc.naive_forecast(daily(t), KEYS, 14, tail=7, weekend=1.0)
    return fc.ensemble({"month": (_naive(t), 0.6), "week": (short, 0.4)}, KEYS)


@query(
    "forecast_with_regressors",
    "FC-5",
    f"""
, d AS (SELECT city_id, sale_date, sum(sale_amount) AS a FROM sales GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY sale_date DESC) dn FROM d),
ts AS (SELECT city_id, {MEAN('a', 'dn<=30')} m, max(sale_date) ld FROM r GROUP BY 1),
nf AS (SELECT city_id, (ld+h.i::INT) dt, m*CASE WHEN isodow(ld+h.i::INT)>=6 THEN 0.8::DOUBLE ELSE 1 END p FROM ts, range(1,31) h(i)),
pd AS (SELECT s.city_id, x::DATE dt, count(*) n, avg(discount_percentage) dp FROM (SELECT store_id, discount_percentage, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) x FROM promotions WHERE store_id IS NOT NULL) JOIN store s USING (store_id) GROUP BY 1,2),
nw AS (SELECT city_id, month(date) mm, avg(avg_temperature) avg_temperature, avg(precpt) precpt FROM weather GROUP BY 1,2)
SELECT nf.city_id, nf.dt::VARCHAR AS date, {q('p')} AS forecast, {q('avg_temperature')} AS avg_temperature, {q('precpt')} AS precpt, coalesce(n,0)::BIGINT AS promo_count, {q('coalesce(dp,0)')} AS promo_discount
FROM nf LEFT JOIN nw w ON w.city_id=nf.city_id AND w.mm=month(nf.dt) LEFT JOIN pd ON pd.city_id=nf.city_id AND pd.dt=nf.dt""",
)
def forecast_with_regressors(t):
    from ..operators.relational import promotion_days

    s = t.sales(category=False)
    d = s.groupBy("city_id", "sale_date").agg(F.sum("sale_amount").alias("sale_amount"))
    f = fc.naive_forecast(d, ["city_id"], 30).drop("lower", "upper")
    own = promotion_days(t.promotions.filter(F.col("store_id").isNotNull())).join(t.store.select("store_id", "city_id"), "store_id")
    p = own.groupBy("city_id", F.col("sale_date").alias("date")).agg(
        F.count(F.lit(1)).alias("promo_count"), F.avg("discount_percentage").alias("promo_discount")
    )
    # no weather is known ahead: the mean of the city's month stands for it
    normal = t.weather.groupBy("city_id", F.month("date").alias("month")).agg(F.avg("avg_temperature").alias("avg_temperature"), F.avg("precpt").alias("precpt"))
    w = f.select("city_id", "date", F.month("date").alias("month")).join(normal, ["city_id", "month"]).drop("month")
    return fc.with_future_regressors(f, w, p)


@query(
    "forecast_rollup",
    "FC-10 AGG-16 CMB-13",
    f"""{_NAIVE}
SELECT dt::VARCHAR AS date, city_id, first_category, {q('sum(f)')} AS forecast, count(*) AS series FROM naive GROUP BY GROUPING SETS ((dt, city_id), (dt, first_category), (dt))""",
)
def forecast_rollup(t):
    return fc.rollup(_naive(t), KEYS)


@query(
    "forecast_growth",
    "FC-10",
    f"""{_NAIVE}
, f AS (SELECT city_id, first_category, sum(f) tp, avg(f) ap FROM naive GROUP BY 1,2), h AS (SELECT city_id, first_category, {MEAN('a')} ah, stddev_samp(a::DOUBLE) vo, count(*) n FROM d GROUP BY 1,2),
j AS (SELECT *, (ap-ah)/ah*100 g FROM f JOIN h USING (city_id, first_category))
SELECT city_id, first_category, {q('tp')} AS total_predicted, {q('ap')} AS avg_predicted, {q('ah')} AS avg_history, {q('vo')} AS volatility, n AS data_points, {q('g')} AS growth_pct,
  CASE WHEN g>10 THEN 'expand' WHEN g>0 THEN 'maintain' WHEN g>-10 THEN 'watch' ELSE 'reduce' END AS advice FROM j""",
)
def forecast_growth(t):
    return fc.growth_insights(_naive(t), daily(t), KEYS)


_BACK = f"""{DAILY}
, b AS (SELECT *, CASE WHEN count(*) OVER w=7 THEN sum(a) OVER w::DOUBLE/7 END f, row_number() OVER (PARTITION BY city_id, first_category ORDER BY sale_date DESC) dn FROM d
  WINDOW w AS (PARTITION BY city_id, first_category ORDER BY sale_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, a::DOUBLE-f er FROM b WHERE dn<=30 AND f IS NOT NULL)"""


@query(
    "forecast_accuracy",
    "FC-11 CMB-15",
    f"""{_BACK}
SELECT city_id, first_category, count(*) AS points, {q('avg(abs(er)/a::DOUBLE)*100')} AS mape, {q('sqrt(avg(er*er))')} AS rmse, {q('avg(abs(er))')} AS mae, {q('avg(er)')} AS bias, {q('sum(er)/avg(abs(er))')} AS tracking_signal FROM e GROUP BY 1,2""",
)
def forecast_accuracy(t):
    return fc.accuracy(fc.backtest(daily(t), KEYS), KEYS)


@query(
    "series_dashboard",
    "FC-13",
    f"""
, d AS (SELECT city_id, first_category, sale_date, sum(units_sold)::BIGINT u, sum(sale_amount) a, max(stock_hour6_22_cnt) h, max(stock_level) sl, bool_or(activity_flag) pf, any_value(avg_temperature) tp FROM sales GROUP BY 1,2,3),
b AS (SELECT *, CASE WHEN count(*) OVER w=7 THEN sum(a) OVER w::DOUBLE/7 END f, row_number() OVER (PARTITION BY city_id, first_category ORDER BY sale_date DESC) dn FROM d
  WINDOW w AS (PARTITION BY city_id, first_category ORDER BY sale_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
g AS (SELECT city_id, first_category, count(*) n, {MEAN('a')} av, least(95,greatest(70,95-stddev_samp(a::DOUBLE)/{MEAN('a')}*100)) cf, {MEAN('a', 'dn<=30')} nw, {MEAN('a', 'dn BETWEEN 31 AND 60')} od, coalesce(abs({corr_sql('a', 'tp')}),0) wf,
  ({MEAN('a', 'pf')}-{MEAN('a', 'NOT pf')})/{MEAN('a', 'NOT pf')}*100 pu, max(sl) FILTER (WHERE dn=1)/{MEAN('u')} sd, (count(*) FILTER (WHERE h>0))::DOUBLE/count(*) sr, avg(abs(a::DOUBLE-f)/a::DOUBLE) FILTER (WHERE dn<=30 AND f IS NOT NULL)*100 mp FROM b GROUP BY 1,2),
wk AS (SELECT city_id, first_category, isodow(sale_date)-1 w, {MEAN('a')} m FROM d GROUP BY 1,2,3), pk AS (SELECT city_id, first_category, arg_max(w,m)::INT pd FROM wk GROUP BY 1,2)
SELECT city_id, first_category, n AS days, {q('av')} AS avg_daily_sales, {q('cf')} AS confidence, {q('wf')} AS weather_factor, {q('coalesce(pu,0)')} AS promotion_uplift, {q('sd')} AS stock_days, {q('sr')} AS stockout_risk, pd AS peak_day,
  {q('least(95,greatest(60,100-mp))')} AS forecast_accuracy, {q('coalesce((nw-od)/od*100,0)')} AS growth_pct FROM g JOIN pk USING (city_id, first_category)""",
)
def series_dashboard(t):
    d = t.daily(*KEYS).select(*KEYS, "sale_date", "units_sold", "sale_amount", "stock_hours", "stock_level", "activity_flag")
    w = t.weather.select("city_id", F.col("date").alias("sale_date"), "avg_temperature")
    return fc.series_dashboard(d.join(w, ["city_id", "sale_date"]), KEYS)


# ---- models: rows, repeatability and error are checked by tests ----------------------------------


def _daily_weather(t):
    d = t.daily(*KEYS).select(*KEYS, "sale_date", "units_sold", "sale_amount", "discount", "activity_flag", "holiday_flag")
    return d.join(t.weather.withColumnRenamed("date", "sale_date"), ["city_id", "sale_date"])


@query("seasonal_forecast", "FC-3")
def seasonal_forecast(t):
    return fc.seasonal_forecast(_daily_weather(t), KEYS, 14, regressors=["avg_temperature", "precpt", "discount"])


@query("forest_forecast", "FC-2 FEA-10 FEA-12")
def forest_forecast(t):
    return fc.forest_forecast(_daily_weather(t), KEYS, 14)


@query("three_way_ensemble", "FC-4 FC-2 FC-3")
def three_way_ensemble(t):
    parts = {"seasonal": (seasonal_forecast(t), 0.5), "forest": (forest_forecast(t), 0.3), "naive": (_naive(t), 0.2)}
    return fc.ensemble(parts, KEYS)


@query("category_model_forecast", "FC-6")
def category_model_forecast(t):
    return fc.category_forecast(t.daily("first_category", geo=False), 14)


def _weather_rows(t):
    d = t.daily("city_id", category=False).select("city_id", "sale_date", "units_sold")
    return fc.weather_rows(features.weather_model_features(d, t.weather))


@query("weather_model_scores", "FC-7 CMB-8")
def weather_model_scores(t):
    rows = _weather_rows(t)
    return fc.weather_model_scores(fc.fit_weather_models(rows), rows)


@query("weather_model_importance", "FC-7")
def weather_model_importance(t):
    return fc.weather_importance(fc.fit_weather_models(_weather_rows(t), ("gradient_boost", "random_forest")), t.spark)


@query("weather_model_scenarios", "FC-7 FC-9 CMB-8")
def weather_model_scenarios(t):
    rows = _weather_rows(t)
    models = fc.fit_weather_models(rows)
    temp, rain = F.col("avg_temperature"), F.col("precpt")
    return fc.scenario_predictions(
        models,
        rows,
        {
            "optimistic": {"avg_temperature": F.lit(22.5), "precpt": F.lit(0.0), "avg_humidity": F.lit(50.0)},
            "pessimistic": {"avg_temperature": temp + 8, "precpt": rain + 10},
        },
    )


@query("weather_partial_dependence", "FC-8 CMB-8")
def weather_partial_dependence(t):
    rows = _weather_rows(t)
    return fc.partial_dependence(fc.fit_weather_models(rows), rows, "avg_temperature")


_UK = ["store_id", "first_category"]


@query("uplift_model_scores", "UPL-1")
def uplift_model_scores(t):
    return up.uplift_scores(up.uplift_rows(t.sales(), _UK))


@query("uplift_cross_validation", "UPL-1")
def uplift_cross_validation(t):
    return up.uplift_cross_validation(up.uplift_rows(t.sales(), _UK))


@query("promotion_simulation", "PRM-8")
def promotion_simulation(t):
    return up.simulate_promotions(up.promotion_grid(t.sales(), _UK), _UK, top=50)


@query("promotion_simulation_summary", "PRM-8")
def promotion_simulation_summary(t):
    return up.simulation_summary(up.promotion_grid(t.sales(), _UK))


@query("uplift_importance", "UPL-1")
def uplift_importance(t):
    return up.uplift_importance(up.uplift_rows(t.sales(), _UK))


@query("optimal_discounts", "PRM-12 PRM-14")
def optimal_discounts(t):
    return up.optimal_discounts(t.sales(), _UK, min_rows=20)


@query("hourly_stockout_probability", "CLS-1 FN-18")
def hourly_stockout_probability(t):
    return up.hourly_stockout_probability(t.sales(category=False))
