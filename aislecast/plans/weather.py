"""Weather queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import weather as wea
from .features import MEAN
from .registry import corr_sql, q, query


def _bins(factor, n):
    return f"""
, e AS (SELECT min({factor}) lo, max({factor}) hi FROM sales),
b AS (SELECT sale_amount, least(floor(({factor}-lo)*{n}/(hi-lo))+1,{n})::INT bin FROM sales, e),
g AS (SELECT bin, {MEAN('sale_amount')} m, stddev_samp(sale_amount::DOUBLE) s, count(*) n FROM b GROUP BY 1)
SELECT bin, {q('m')} AS mean_sales, {q('s')} AS std_sales, n AS "rows", m=max(m) OVER () AS is_optimal FROM g"""


@query("temperature_sensitivity", "WEA-1 WIN-16", _bins("avg_temperature", 10))
def temperature_sensitivity(t):
    return wea.sensitivity_by_bin(t.sales(category=False), "avg_temperature", 10)


@query("humidity_sensitivity", "WEA-1", _bins("avg_humidity", 10))
def humidity_sensitivity(t):
    return wea.sensitivity_by_bin(t.sales(category=False), "avg_humidity", 10)


@query("wind_sensitivity", "WEA-1", _bins("avg_wind_level", 5))
def wind_sensitivity(t):
    return wea.sensitivity_by_bin(t.sales(category=False), "avg_wind_level", 5)


@query(
    "rain_sensitivity",
    "WEA-1 FN-12",
    f"""
, g AS (SELECT CASE WHEN precpt<=0 THEN 'none' WHEN precpt<=5 THEN 'light' WHEN precpt<=15 THEN 'moderate' ELSE 'heavy' END bin, {MEAN('sale_amount')} m, stddev_samp(sale_amount::DOUBLE) s, count(*) n FROM sales GROUP BY 1)
SELECT bin, {q('m')} AS mean_sales, {q('s')} AS std_sales, n AS "rows", m=max(m) OVER () AS is_optimal FROM g""",
)
def rain_sensitivity(t):
    return wea.sensitivity_by_rain(t.sales(category=False))


_EL = """
, d AS (SELECT city_id, sale_date, sum(sale_amount) a FROM sales GROUP BY 1,2),
j AS (SELECT d.city_id, sale_date, a, avg_temperature t, avg_humidity h, precpt p, avg_wind_level w FROM d JOIN weather x ON x.city_id=d.city_id AND x.date=d.sale_date),
c AS (SELECT city_id, (a-lag(a) OVER o)::DOUBLE/(lag(a) OVER o)::DOUBLE dy, (t-lag(t) OVER o)/nullif(lag(t) OVER o,0) dt, (h-lag(h) OVER o)/nullif(lag(h) OVER o,0) dh,
  (p-lag(p) OVER o)/nullif(lag(p) OVER o,0) dp, (w-lag(w) OVER o)/nullif(lag(w) OVER o,0) dw FROM j WINDOW o AS (PARTITION BY city_id ORDER BY sale_date)),
l AS (""" + " UNION ALL ".join(
    f"""SELECT city_id, '{f}' factor, stddev_samp(dy) FILTER (WHERE {c} IS NOT NULL AND dy IS NOT NULL) sy, stddev_samp({c}) FILTER (WHERE {c} IS NOT NULL AND dy IS NOT NULL) sx, {corr_sql('dy', c)} r FROM c GROUP BY 1"""
    for f, c in (("avg_temperature", "dt"), ("avg_humidity", "dh"), ("precpt", "dp"), ("avg_wind_level", "dw"))
) + "), el AS (SELECT city_id, factor, coalesce(sy/nullif(sx,0)*r,0) e, coalesce(r,0) r FROM l)"
_CLS = "CASE WHEN {x}>1 THEN 'highly_elastic' WHEN {x}>0.5 THEN 'moderately_elastic' WHEN {x}>0.1 THEN 'slightly_elastic' ELSE 'inelastic' END"


def _elasticity(t):
    d = t.daily("city_id", category=False).select("city_id", "sale_date", "sale_amount")
    return wea.elasticity(d.join(t.weather.withColumnRenamed("date", "sale_date"), ["city_id", "sale_date"]), ["city_id"])


@query(
    "weather_elasticity",
    "WEA-2 WIN-9",
    f"""{_EL}
SELECT city_id, factor, {q('e')} AS elasticity, {q('r')} AS change_corr, {_CLS.format(x='abs(r)')} AS class FROM el""",
)
def weather_elasticity(t):
    return _elasticity(t)


@query(
    "weather_elasticity_class",
    "WEA-2",
    f"""{_EL}
SELECT city_id, {q('max(abs(r))')} AS max_abs, arg_max(factor, abs(r)) AS main_factor, {_CLS.format(x='max(abs(r))')} AS class FROM el GROUP BY 1""",
)
def weather_elasticity_class(t):
    return wea.overall_elasticity_class(_elasticity(t), ["city_id"])


_SEASON = "CASE WHEN month(sale_date) IN (12,1,2) THEN 'winter' WHEN month(sale_date)<=5 THEN 'spring' WHEN month(sale_date)<=8 THEN 'summer' ELSE 'autumn' END"


@query(
    "seasonal_weather_patterns",
    "WEA-3 FN-7",
    f"""
SELECT first_category, {_SEASON} AS season, year(sale_date)::INT AS year, count(*) AS "rows", {q(MEAN('sale_amount'))} AS avg_sales, {q('stddev_samp(sale_amount::DOUBLE)')} AS std_sales, {q('avg(avg_temperature)')} AS avg_temperature,
  {q('avg(avg_humidity)')} AS avg_humidity, {q('avg(precpt)')} AS avg_precipitation, {q('(count(*) FILTER (WHERE stock_hour6_22_cnt>0))::DOUBLE/count(*)')} AS stockout_rate, {q(corr_sql('sale_amount', 'avg_temperature'))} AS temp_corr
FROM sales GROUP BY 1,2,3""",
)
def seasonal_weather_patterns(t):
    return wea.seasonal_patterns(t.sales(), ["first_category"], by_year=True)


_OPT = "UNION ALL ".join(
    f"SELECT '{f}' AS factor, {q(f'quantile_cont({f},0.25)')} AS q25, {q(f'quantile_cont({f},0.75)')} AS q75, {q(f'avg({f})')} AS mean, count(*) AS \"rows\", {q('(' + MEAN('sale_amount') + '/(SELECT ' + MEAN('sale_amount') + ' FROM sales)-1)*100')} AS sales_vs_overall_pct FROM tp "
    for f in ("avg_temperature", "avg_humidity", "precpt")
)


@query(
    "optimal_conditions",
    "WEA-4 AGG-8",
    f""", tp AS (SELECT * FROM sales WHERE sale_amount::DOUBLE >= (SELECT quantile_cont(sale_amount::DOUBLE,0.75) FROM sales))
{_OPT}""",
)
def optimal_conditions(t):
    return wea.optimal_conditions(t.sales(category=False))


@query(
    "extreme_weather_impact",
    "WEA-5 AGG-8",
    f"""
, c AS (SELECT quantile_cont(avg_temperature,0.95) h, quantile_cont(avg_temperature,0.05) l, quantile_cont(precpt,0.9) r FROM sales), s AS (SELECT sale_amount v, avg_temperature>=h a, avg_temperature<=l b, avg_temperature>l AND avg_temperature<h n, precpt>r p, precpt=0 z FROM sales, c)
SELECT {q('(' + MEAN('v', 'a') + '/' + MEAN('v', 'n') + '-1)*100')} AS extreme_heat_pct, {q('(' + MEAN('v', 'b') + '/' + MEAN('v', 'n') + '-1)*100')} AS extreme_cold_pct, {q('(' + MEAN('v', 'p') + '/' + MEAN('v', 'z') + '-1)*100')} AS heavy_rain_pct FROM s""",
)
def extreme_weather_impact(t):
    return wea.extreme_impact(t.sales(category=False))


_SC = {
    "extreme_heat": "avg_temperature>=30", "extreme_cold": "avg_temperature<=2", "heavy_rain": "precpt>=10", "drought": "precpt<=0.1", "high_humidity": "avg_humidity>=85",
    "perfect_weather": "avg_temperature BETWEEN 20 AND 26 AND avg_humidity BETWEEN 40 AND 60 AND precpt<=2",
}


@query(
    "weather_scenario_impacts",
    "WEA-6",
    ", w AS (" + " UNION ALL ".join(f"SELECT '{n}' scenario, sale_amount v FROM sales WHERE {c}" for n, c in _SC.items())
    + f"""), g AS (SELECT scenario, count(*) n, {MEAN('v')} m, (SELECT {MEAN('sale_amount')} FROM sales) b FROM w GROUP BY 1 HAVING count(*)>5)
SELECT scenario, n AS frequency, {q('m')} AS avg_sales, {q('b')} AS baseline_sales, {q('(m-b)/b*100')} AS impact_pct, CASE WHEN abs((m-b)/b*100)>20 THEN 'high' WHEN abs((m-b)/b*100)>10 THEN 'medium' ELSE 'low' END AS risk_level FROM g""",
)
def weather_scenario_impacts(t):
    return wea.scenario_impacts(t.sales(category=False), wea.scenario_conditions(heat=30, cold=2, rain=10, humid=85))


_FCST = """
, ld AS (SELECT city_id, max(date) d FROM weather GROUP BY 1),
fw AS (SELECT w.city_id, (w.date + 365)::DATE AS date, avg_temperature+2 AS ft, avg_humidity AS fh, precpt+1 AS fp FROM weather w JOIN ld ON ld.city_id=w.city_id WHERE w.date > ld.d-14)"""


def _outlook(t):
    """Weather of the coming year's fortnight: the last fortnight, two degrees warmer and wetter."""
    last = t.weather.groupBy("city_id").agg(F.max("date").alias("_d"))
    w = t.weather.join(last, "city_id").filter(F.col("date") > F.date_sub("_d", 14))
    return w.select(
        "city_id",
        F.date_add("date", 365).alias("date"),
        (F.col("avg_temperature") + 2).alias("avg_temperature"),
        "avg_humidity",
        (F.col("precpt") + 1).alias("precpt"),
    )


@query(
    "weather_what_if",
    "WEA-7",
    f"""{_FCST}
, g AS (SELECT city_id, {MEAN('sale_amount')} b, coalesce({corr_sql('sale_amount', 'avg_temperature')},0) rt, coalesce({corr_sql('sale_amount', 'avg_humidity')},0) rh, coalesce({corr_sql('sale_amount', 'precpt')},0) rp, avg(avg_temperature) tm, stddev_samp(avg_temperature) ts, avg(avg_humidity) hm FROM sales GROUP BY 1),
j AS (SELECT fw.*, b, rt, b*(1+rt*(ft-tm)*0.1)*(1+rh*(fh-hm)/100)*(1+rp*fp*0.05) raw, CASE WHEN abs(ft-tm)>ts THEN 0.25 ELSE 0.15 END u FROM fw JOIN g USING (city_id))
SELECT city_id, date::VARCHAR AS date, {q('greatest(0,raw)')} AS predicted_sales, {q('greatest(0,raw*(1-u))')} AS lower, {q('raw*(1+u)')} AS upper, {q('rt*b*0.01')} AS impact_per_degree FROM j""",
)
def weather_what_if(t):
    return wea.linear_what_if(t.sales(category=False), _outlook(t), ["city_id"])


@query(
    "weather_volatility",
    "WEA-8 WIN-14 AGG-8",
    f"""
, i AS (SELECT city_id, date, precpt<1 dry, row_number() OVER (PARTITION BY city_id ORDER BY date)-row_number() OVER (PARTITION BY city_id, precpt<1 ORDER BY date) isl FROM weather),
sp AS (SELECT city_id, max(n) ds FROM (SELECT city_id, isl, dry, CASE WHEN dry THEN count(*) ELSE 0 END n FROM i GROUP BY 1,2,3) GROUP BY 1),
qq AS (SELECT city_id, quantile_cont(avg_temperature,0.05) q5, quantile_cont(avg_temperature,0.95) q95, quantile_cont(precpt,0.99) fl FROM weather GROUP BY 1),
g AS (SELECT w.city_id, count(*) n, stddev_samp(avg_temperature) s, stddev_samp(avg_temperature)/avg(avg_temperature)*100 cv, count(*) FILTER (WHERE avg_temperature>q95) hd, count(*) FILTER (WHERE avg_temperature<q5) cd, count(*) FILTER (WHERE precpt>10) rd,
  count(*) FILTER (WHERE avg_humidity>90) md, count(*) FILTER (WHERE avg_humidity<30) ad, any_value(fl) fl FROM weather w JOIN qq ON qq.city_id=w.city_id GROUP BY 1),
r AS (SELECT g.*, ds, (CASE WHEN cv>20 THEN 2 ELSE 0 END+CASE WHEN hd+cd+rd>n*0.1 THEN 3 ELSE 0 END+CASE WHEN fl>20 THEN 2 ELSE 0 END)::INT sc FROM g JOIN sp USING (city_id))
SELECT city_id, n AS days, {q('s')} AS temp_std, {q('cv')} AS temp_cv, hd AS hot_days, cd AS cold_days, rd AS heavy_rain_days, md AS humid_days, ad AS dry_air_days, {q('fl')} AS flood_q99, ds::BIGINT AS dry_spell, sc AS risk_score,
  CASE WHEN sc>=5 THEN 'High Risk' WHEN sc>=3 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_class FROM r""",
)
def weather_volatility(t):
    return wea.volatility(t.weather)


@query(
    "weather_revenue_at_risk",
    "WEA-8",
    f"""
, s AS (SELECT avg(avg_temperature) m, stddev_samp(avg_temperature) sd, coalesce({corr_sql('sale_amount', 'avg_temperature')},0) rt, coalesce({corr_sql('sale_amount', 'precpt')},0) rp, {MEAN('sale_amount')} b, quantile_cont(precpt,0.95) rq FROM sales),
p AS (SELECT (count(*) FILTER (WHERE avg_temperature>m+2*sd))::DOUBLE/count(*)*100 ph, (count(*) FILTER (WHERE avg_temperature<m-2*sd))::DOUBLE/count(*)*100 pc FROM sales, s),
r AS (SELECT 'extreme_heat' sc, ph pr, rt*2*sd*0.1 im FROM s, p UNION ALL SELECT 'extreme_cold', pc, -(rt*2*sd*0.1) FROM s, p UNION ALL SELECT 'heavy_precipitation', 5, rp*rq*0.1 FROM s)
SELECT sc AS scenario, {q('pr')} AS probability, {q('im')} AS sales_impact, {q('b*100*abs(im)')} AS daily_revenue_impact, {q('30*pr/100')} AS expected_days, {q('30*pr/100*(b*100*abs(im))')} AS revenue_at_risk FROM r, s""",
)
def weather_revenue_at_risk(t):
    return wea.revenue_at_risk(t.sales(category=False))


@query(
    "climate_trend",
    "WEA-9 AGG-13",
    f"""
, y AS (SELECT city_id, year(date) y, avg(avg_temperature) t, avg(precpt) r FROM weather GROUP BY 1,2),
g AS (SELECT city_id, count(*) n, regr_slope(t,y) ts, regr_slope(r,y) rs, arg_max(t,y)-arg_min(t,y) tc FROM y GROUP BY 1 HAVING count(*)>1)
SELECT city_id, n AS years, {q('ts')} AS temp_slope, {q('rs')} AS rain_slope, {q('tc')} AS temp_change, CASE WHEN ts>0 THEN 'warming' ELSE 'cooling' END AS temp_direction,
  CASE WHEN abs(ts)>0.1 THEN 'significant' ELSE 'minimal' END AS temp_significance, CASE WHEN rs>0 THEN 'increasing' ELSE 'decreasing' END AS rain_direction FROM g""",
)
def climate_trend(t):
    return wea.climate_trend(t.weather, ["city_id"])


@query(
    "climate_projection",
    "WEA-9",
    f"""
, g AS (SELECT city_id, {MEAN('sale_amount')} b, avg(avg_temperature) t, avg(precpt) p, coalesce({corr_sql('sale_amount', 'avg_temperature')},0) rt, coalesce({corr_sql('sale_amount', 'precpt')},0) rp FROM sales GROUP BY 1),
s(sc, dt, fp) AS (VALUES ('current',0.0::DOUBLE,1.0::DOUBLE),('warmer',2.0,0.95),('more_volatile',0.5,1.2)),
j AS (SELECT *, rt*dt*0.1+rp*(p*fp-p)*0.05 e FROM g, s)
SELECT city_id, sc AS scenario, {q('t+dt')} AS temperature, {q('p*fp')} AS precipitation, {q('b')} AS baseline, {q('b*(1+e)')} AS projected_sales, {q('e*100')} AS impact_pct FROM j""",
)
def climate_projection(t):
    return wea.climate_projection(t.sales(category=False), ["city_id"])


@query(
    "condition_effects",
    "WEA-10 FN-11",
    f"""
, g AS (SELECT product_id, CASE WHEN avg_temperature<18 THEN 'cold' WHEN avg_temperature>25 THEN 'warm' ELSE 'mild' END tc, CASE WHEN precpt>5 THEN 'rainy' WHEN precpt<1 THEN 'dry' ELSE 'normal' END rc, count(*) n, {MEAN('sale_amount')} a FROM sales GROUP BY 1,2,3 HAVING count(*)>=3)
SELECT product_id, tc AS temp_class, rc AS rain_class, n AS "rows", {q('a')} AS avg_sales, (row_number() OVER (PARTITION BY product_id ORDER BY a DESC, tc, rc))::INT AS best_place, (row_number() OVER (PARTITION BY product_id ORDER BY a, tc, rc))::INT AS worst_place,
  {q('avg(a) OVER (PARTITION BY product_id)')} AS mean_of_conditions, {q('stddev_samp(a) OVER (PARTITION BY product_id)/avg(a) OVER (PARTITION BY product_id)')} AS sensitivity FROM g""",
)
def condition_effects(t):
    return wea.condition_effects(t.sales(category=False), ["product_id"])


@query(
    "city_climatology",
    "WEA-13",
    f"""
, g AS (SELECT city_id, avg(avg_temperature) t, avg(precpt) p, avg(avg_humidity) h, avg(avg_wind_level) w FROM weather GROUP BY 1), o AS (SELECT avg(avg_temperature) t, avg(precpt) p, avg(avg_humidity) h, avg(avg_wind_level) w FROM weather),
j AS (SELECT c.city_id, coalesce(g.t,o.t) t, coalesce(g.p,o.p) p, coalesce(g.h,o.h) h, coalesce(g.w,o.w) w FROM city c LEFT JOIN g ON g.city_id=c.city_id, o)
SELECT city_id, {q('t')} AS temperature, {q('p')} AS precipitation, {q('h')} AS humidity, {q('w')} AS wind_level, CASE WHEN p>5 THEN 'rainy' WHEN p<1 THEN 'dry' WHEN t<18 THEN 'cold' WHEN t>25 THEN 'warm' ELSE 'mild' END AS weather_category FROM j""",
)
def city_climatology(t):
    return wea.city_climatology(t.weather, t.city)


@query(
    "similar_conditions",
    "WEA-14",
    f"""
, g AS (SELECT store_id, {MEAN('sale_amount')} b, {MEAN('sale_amount', 'abs(avg_temperature-20)<=5 AND abs(avg_humidity-50)<=20')} p, count(*) FILTER (WHERE abs(avg_temperature-20)<=5 AND abs(avg_humidity-50)<=20) n FROM sales GROUP BY 1)
SELECT store_id, {q('b')} AS baseline_sales, {q('coalesce(p,b)')} AS predicted_sales, {q('(coalesce(p,b)-b)/b*100')} AS impact_pct, {q('CASE WHEN n>0 THEN least(n/20,1) ELSE 0.1 END')} AS confidence FROM g""",
)
def similar_conditions(t):
    return wea.similar_conditions(t.sales(category=False), ["store_id"], 20.0, 50.0)


@query(
    "weather_base",
    "CMB-2 FN-5 FN-7 FN-9",
    f"""
SELECT sale_date::VARCHAR AS sale_date, store_id, product_id, {_SEASON} AS season, (isodow(sale_date)-1)::INT AS day_of_week, {q('avg_temperature*avg_humidity/100')} AS temp_humidity, {q('avg_temperature*avg_temperature')} AS temp_squared,
  {q('1-abs(avg_temperature-22.5::DOUBLE)/30')} AS comfort, precpt>0.1 AS is_rainy, precpt>10 AS is_heavy_rain FROM sales""",
)
def weather_base(t):
    return wea.weather_base(t.sales(category=False)).select(
        "sale_date", "store_id", "product_id", "season", "day_of_week", "temp_humidity", "temp_squared", "comfort", "is_rainy", "is_heavy_rain"
    )
