"""Window and ordering queries over daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import ladder, mean_of
from ..operators import ranking, series
from .registry import q, query

# daily series per city and category, the density at which lags and frames are meaningful
DAILY = """
, d AS (SELECT city_id, first_category, sale_date, sum(units_sold)::BIGINT AS u, sum(sale_amount) AS a FROM sales GROUP BY 1,2,3)"""
KEYS = ["city_id", "first_category"]
_P = "PARTITION BY city_id, first_category ORDER BY sale_date"


def daily(t):
    return t.daily(*KEYS).select(*KEYS, "sale_date", "units_sold", "sale_amount")


def _roll(n, guard=True):
    f = f"OVER ({_P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    g = lambda e: f"CASE WHEN count(u) {f}={n} THEN {e} END" if guard else e
    return (
        f"{q(g(f'sum(u) {f}::DOUBLE/count(u) {f}'))} AS roll_mean_{n}, {q(g(f'stddev_samp(u::DOUBLE) {f}'))} AS roll_std_{n}, "
        f"{g(f'min(u) {f}')} AS roll_min_{n}, {g(f'max(u) {f}')} AS roll_max_{n}"
    )


def _rm(n):
    f = f"OVER ({_P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(u) {f}={n} THEN sum(u) {f}::DOUBLE/count(u) {f} END"


@query(
    "lag_roll_features",
    "WIN-5 WIN-6 WIN-8 FEA-5",
    f"""{DAILY}
SELECT city_id, first_category, sale_date::VARCHAR AS sale_date, u AS units_sold, {q('a')} AS sale_amount,
  {', '.join(f'lag(u,{n}) OVER ({_P}) AS lag_{n}' for n in (1, 7, 14, 30))}, {', '.join(_roll(n) for n in (7, 14, 30))},
  {q(f'({_rm(7)} - lag(u,7) OVER ({_P}))/nullif(lag(u,7) OVER ({_P}),0)')} AS short_trend,
  {q(f'({_rm(30)} - lag(u,30) OVER ({_P}))/nullif(lag(u,30) OVER ({_P}),0)')} AS long_trend,
  {q(f'{_rm(7)} - {_rm(14)}')} AS roll_gap
FROM d""",
)
def lag_roll_features(t):
    return series.lag_roll_features(daily(t), KEYS, "units_sold")


@query(
    "rolling_any_length",
    "WIN-7",
    f"""{DAILY}
SELECT city_id, first_category, sale_date::VARCHAR AS sale_date, u AS units_sold, {_roll(7, False)} FROM d""",
)
def rolling_any_length(t):
    d = daily(t).drop("sale_amount")
    return series.lag_roll_features(d, KEYS, "units_sold", lags=(), rolls=(7,), min_periods=True)


_B = f"OVER ({_P} ROWS BETWEEN 21 PRECEDING AND 8 PRECEDING)"


@query(
    "moving_baseline",
    "WIN-3 WIN-4",
    f"""{DAILY}
, z AS (SELECT city_id, first_category, sale_date, u, lag(u,7) OVER ({_P}) AS wk,
  sum(u) {_B}::DOUBLE/nullif(count(u) {_B},0) AS m, stddev_samp(u::DOUBLE) {_B} AS s FROM d)
SELECT city_id, first_category, sale_date::VARCHAR AS sale_date, u AS units_sold, wk AS week_ago, {q('m')} AS baseline_mean,
  {q('s')} AS baseline_std, {q('CASE WHEN s>0 THEN (u-m)/s ELSE 0 END')} AS z_score FROM z""",
)
def moving_baseline(t):
    return series.moving_baseline(daily(t).drop("sale_amount"), KEYS, "units_sold")


@query(
    "recent_change",
    "WIN-9",
    f"""{DAILY}
, c AS (SELECT *, (u - lag(u) OVER ({_P}))::DOUBLE/nullif(lag(u) OVER ({_P}),0) AS pc,
  row_number() OVER (PARTITION BY city_id, first_category ORDER BY sale_date DESC) AS rn FROM d)
SELECT city_id, first_category, {q('avg(pc)')} AS mean_change, count(*) AS "rows" FROM c WHERE rn<=14 GROUP BY 1,2""",
)
def recent_change(t):
    return series.recent_change(daily(t), KEYS, "units_sold")


@query(
    "weather_differences",
    "WIN-10",
    f"""
SELECT city_id, date::VARCHAR AS date, {q('avg_temperature')} AS avg_temperature,
  {q('avg_temperature - lag(avg_temperature) OVER (PARTITION BY city_id ORDER BY date)')} AS avg_temperature_diff,
  {q('''CASE WHEN count(*) OVER (PARTITION BY city_id ORDER BY date ROWS 6 PRECEDING)=7 THEN
     stddev_samp(avg_temperature) OVER (PARTITION BY city_id ORDER BY date ROWS 6 PRECEDING) END''')} AS avg_temperature_volatility
FROM weather""",
)
def weather_differences(t):
    w = t.weather.select("city_id", "date", "avg_temperature")
    return series.differences(w, ["city_id"], "avg_temperature", day="date")


@query(
    "head_tail_growth",
    "WIN-11",
    f"""{DAILY}
, r AS (SELECT *, row_number() OVER ({_P}) up, row_number() OVER (PARTITION BY city_id, first_category ORDER BY sale_date DESC) dn FROM d),
m AS (SELECT city_id, first_category, sum(a) FILTER (WHERE up<=30)::DOUBLE/count(*) FILTER (WHERE up<=30) f,
  sum(a) FILTER (WHERE dn<=30)::DOUBLE/count(*) FILTER (WHERE dn<=30) l,
  sum(a) FILTER (WHERE dn BETWEEN 31 AND 60)::DOUBLE/count(*) FILTER (WHERE dn BETWEEN 31 AND 60) p FROM r GROUP BY 1,2)
SELECT city_id, first_category, {q('f')} AS first_mean, {q('l')} AS last_mean, {q('p')} AS previous_mean,
  {q('(l-f)/f*100')} AS growth_pct, {q('(l-p)/p*100')} AS recent_growth_pct FROM m""",
)
def head_tail_growth(t):
    return series.head_tail_growth(daily(t), KEYS, "sale_amount")


@query(
    "longest_dry_spell",
    "WIN-14",
    """
, i AS (SELECT city_id, date, precpt=0 AS dry, date - row_number() OVER (PARTITION BY city_id, precpt=0 ORDER BY date)::INT AS g,
    row_number() OVER (PARTITION BY city_id ORDER BY date) - row_number() OVER (PARTITION BY city_id, precpt=0 ORDER BY date) AS isl FROM weather),
r AS (SELECT city_id, isl, dry, count(*) AS n FROM i GROUP BY 1,2,3)
SELECT city_id, max(CASE WHEN dry THEN n ELSE 0 END)::BIGINT AS longest_run FROM r GROUP BY 1""",
)
def longest_dry_spell(t):
    return series.longest_run(t.weather, ["city_id"], F.col("precpt") == 0, "date")


@query(
    "monthly_temperature_deviation",
    "WIN-13",
    f"""
, w AS (SELECT city_id, date, month(date) m, avg_temperature t FROM weather)
SELECT city_id, date::VARCHAR AS date, {q('t')} AS avg_temperature, m::INT AS month,
  {q('t - avg(t) OVER (PARTITION BY city_id, m)')} AS temp_deviation FROM w""",
)
def monthly_temperature_deviation(t):
    w = t.weather.select("city_id", "date", "avg_temperature", F.month("date").alias("month"))
    return series.deviation_from_group(w, ["city_id", "month"], "avg_temperature", "temp_deviation")


@query(
    "share_of_total",
    "WIN-2",
    f"""
, p AS (SELECT first_category, second_category, sum(sale_amount) AS v FROM sales GROUP BY 1,2),
g AS (SELECT sum(v)::DOUBLE t, count(*) n FROM p)
SELECT first_category, second_category, {q('v')} AS total, {q('v::DOUBLE/t*100')} AS share_pct, {q('v::DOUBLE/(t/n)')} AS relative_to_mean
FROM p, g""",
)
def share_of_total(t):
    return series.share_of_total(t.sales(geo=False), ["first_category", "second_category"], "sale_amount")


@query(
    "equal_width_bins",
    "WIN-16",
    f"""
, e AS (SELECT min(avg_temperature) lo, max(avg_temperature) hi FROM weather),
b AS (SELECT s.sale_amount, least(floor((avg_temperature-lo)*10/(hi-lo))+1, 10)::INT AS bin FROM sales s, e)
SELECT bin, count(*) AS "rows", {q('sum(sale_amount)::DOUBLE/count(*)')} AS mean_amount FROM b GROUP BY 1""",
)
def equal_width_bins(t):
    b = series.equal_width_bins(t.sales(category=False), "avg_temperature", 10)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), mean_of("sale_amount").alias("mean_amount"))


@query(
    "phase_statistics",
    "CUS-5 FN-5",
    f"""{DAILY}
SELECT city_id, (isodow(sale_date)-1)::INT AS phase, {q('sum(a)::DOUBLE/count(*)')} AS mean_value, {q('stddev_samp(a::DOUBLE)')} AS std_value,
  count(*) AS "rows" FROM d GROUP BY 1,2""",
)
def phase_statistics(t):
    return series.phase_statistics(daily(t), ["city_id"], F.weekday("sale_date"), "sale_amount")


@query(
    "product_percent_rank",
    "WIN-12 WIN-1",
    f"""
, p AS (SELECT product_id, sum(units_sold)::BIGINT u FROM lines GROUP BY 1),
r AS (SELECT product_id, u, rank() OVER (ORDER BY u) rk, count(*) OVER (PARTITION BY u) ties, count(*) OVER () n FROM p)
SELECT product_id, u AS units, {q('(rk + (ties-1)/2.0)/n', 6)} AS pct_rank FROM r""",
    digits=6,
)
def product_percent_rank(t):
    p = t.lines().groupBy("product_id").agg(F.sum("units_sold").alias("units"))
    return ranking.with_percent_rank(p, "units")


@query(
    "top_days_per_city",
    "SRT-3",
    f"""
, d AS (SELECT city_id, sale_date, sum(sale_amount) a FROM sales GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY a DESC, sale_date) rn FROM d)
SELECT city_id, sale_date::VARCHAR AS sale_date, {q('a')} AS amount, rn::INT AS place FROM r WHERE rn<=3""",
)
def top_days_per_city(t):
    d = t.sales(category=False).groupBy("city_id", "sale_date").agg(F.sum("sale_amount").alias("amount"))
    return ranking.top_per_group(d, ["city_id"], [F.desc("amount"), F.asc("sale_date")], 3, "place")


@query(
    "priority_order",
    "SRT-4 SRT-2 FN-14",
    f"""
, m AS (SELECT store_id, product_id, max(stock_hour6_22_cnt) h, sum(sale_amount) a FROM lines WHERE sale_date>=(SELECT d FROM ref)-365 GROUP BY 1,2),
p AS (SELECT *, CASE WHEN h>=15 THEN 'immediate' WHEN h>=10 THEN 'high' WHEN h>=5 THEN 'medium' ELSE 'low' END priority FROM m)
SELECT store_id, product_id, {q('a')} AS amount, priority FROM p
ORDER BY CASE priority WHEN 'immediate' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, a DESC, store_id, product_id""",
)
def priority_order(t):
    m = t.lines(since=t.day(365)).groupBy("store_id", "product_id").agg(
        F.max("stock_hour6_22_cnt").alias("hours"), F.sum("sale_amount").alias("amount")
    )
    p = m.withColumn("priority", ladder("hours", [(15, "immediate"), (10, "high"), (5, "medium")], "low"))
    rank = F.when(F.col("priority") == "immediate", 4).when(F.col("priority") == "high", 3)
    rank = rank.when(F.col("priority") == "medium", 2).otherwise(1)
    return p.orderBy(rank.desc(), F.desc("amount"), "store_id", "product_id").drop("hours")
