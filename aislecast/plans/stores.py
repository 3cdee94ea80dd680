"""Store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, stores
from ..session import ensure_checkpoint_dir
from .features import MEAN
from .registry import q, query


@query(
    "store_comparison",
    "STO-1 JN-1 AGG-1 AGG-2 AGG-3 WIN-1",
    f"""
, m AS (
  SELECT store_id, count(DISTINCT product_id)::BIGINT AS active_products, sum(sale_amount) AS total_revenue,
    sum(sale_amount)::DOUBLE/count(*) AS avg_daily_revenue, sum(stock_hour6_22_cnt)::BIGINT AS total_stockout_hours,
    sum(CASE WHEN stock_hour6_22_cnt>0 THEN 1 ELSE 0 END)::DOUBLE/count(*) AS stockout_frequency, count(*) AS days_of_data
  FROM lines WHERE sale_date >= (SELECT d FROM ref) - 90 GROUP BY store_id)
SELECT m.store_id, active_products, {q('total_revenue')} AS total_revenue, {q('avg_daily_revenue')} AS avg_daily_revenue,
  total_stockout_hours, {q('stockout_frequency')} AS stockout_frequency, days_of_data, store_name, city_id, city_name,
  (rank() OVER (PARTITION BY city_id ORDER BY total_revenue DESC))::INT AS city_revenue_rank,
  (rank() OVER (PARTITION BY city_id ORDER BY stockout_frequency))::INT AS city_reliability_rank,
  (rank() OVER (ORDER BY total_revenue DESC))::INT AS overall_revenue_rank
FROM m JOIN store USING (store_id)""",
)
def store_comparison(t):
    return stores.compare_stores(t.lines(since=t.day(90)), t.store)


_SM = f"""
, sm AS (SELECT store_id, sum(sale_amount) ts, {MEAN('sale_amount')} av, count(*) n, count(DISTINCT product_id) pd, coalesce({MEAN('sale_amount', 'activity_flag')}/{MEAN('sale_amount')},1) pe,
  coalesce({MEAN('sale_amount', 'holiday_flag')}/{MEAN('sale_amount')},1) hu, coalesce(1/(1+stddev_samp(sale_amount::DOUBLE)/{MEAN('sale_amount')}),0) cs,
  coalesce({MEAN('sale_amount', 'isodow(sale_date)>=6')}/{MEAN('sale_amount', 'isodow(sale_date)<6')},1) wp FROM sales GROUP BY 1)"""


def _metrics(t):
    # one row per store, read by several passes: cut the lineage once, in the shared folder
    ensure_checkpoint_dir(t.spark)
    return stores.store_metrics(t.sales(geo=False, category=False)).checkpoint()


@query(
    "store_metrics",
    "STO-3 AGG-17",
    f"""{_SM}
SELECT store_id, {q('ts')} AS total_sales, {q('av')} AS avg_daily_sales, n AS transaction_count, pd AS product_diversity, {q('pe')} AS promo_effectiveness, {q('hu')} AS holiday_uplift,
  {q('cs')} AS consistency_score, {q('wp')} AS weekend_performance FROM sm""",
)
def store_metrics(t):
    return _metrics(t)


@query(
    "daily_store_metrics",
    "STO-2 WIN-1",
    f"""
, g AS (SELECT store_id, sale_date, sum(sale_amount) a, sum(units_sold)::BIGINT u, count(DISTINCT product_id) p, sum(stock_hour6_22_cnt)::BIGINT h FROM lines GROUP BY 1,2)
SELECT store_id, sale_date::VARCHAR AS sale_date, {q('a')} AS total_sales, u AS total_units, p AS products_sold, h AS stockout_hours,
  (rank() OVER (PARTITION BY sale_date ORDER BY a DESC))::INT AS performance_rank FROM g""",
)
def daily_store_metrics(t):
    return stores.daily_store_metrics(t.lines())


_CUT = f"""{_SM}
, c AS (SELECT quantile_cont(av,0.25) q25, quantile_cont(av,0.5) q50, quantile_cont(av,0.75) q75, quantile_cont(pe,0.6) p60, quantile_cont(cs,0.6) c60 FROM sm)"""


@query(
    "store_segments",
    "STO-3 STO-7",
    f"""{_CUT}
, s AS (SELECT 'A' segment, sm.* FROM sm, c WHERE av>=q75 UNION ALL SELECT 'B', sm.* FROM sm, c WHERE av>=q50 AND pe>=p60 UNION ALL SELECT 'C', sm.* FROM sm, c WHERE av>=q50 AND cs>=c60
  UNION ALL SELECT 'D', sm.* FROM sm, c WHERE av<=q25)
SELECT segment, count(*) AS stores, {q('avg(av)')} AS avg_sales, {q('avg(pe)')} AS avg_promo_effectiveness, {q('avg(cs)')} AS avg_consistency FROM s GROUP BY 1""",
)
def store_segments(t):
    return stores.store_segments(_metrics(t))


@query(
    "store_segment_listing",
    "STO-7 STO-4",
    f"""{_CUT}
SELECT store_id, {q('av')} AS avg_daily_sales, CASE WHEN av>=q75 THEN 'A' WHEN av>=q50 AND pe>1.2 THEN 'B' WHEN av>=q50 AND cs>0.7 THEN 'C' ELSE 'D' END AS segment FROM sm, c""",
)
def store_segment_listing(t):
    return stores.assign_segment(_metrics(t)).select("store_id", "avg_daily_sales", "segment")


@query(
    "store_profile",
    "STO-4 FN-22 STO-8",
    f"""{_SM}
, x AS (SELECT *, min(av) OVER () a0, max(av) OVER () a1, min(pe) OVER () p0, max(pe) OVER () p1, max(pd) OVER () d1, max(n) OVER () t1, rank() OVER (ORDER BY av) rk, count(*) OVER (PARTITION BY av) ti, count(*) OVER () c FROM sm)
SELECT store_id, {q('(av-a0)/(a1-a0)*100')} AS sales_performance, {q('cs*100')} AS customer_loyalty, {q('least(pd::DOUBLE/d1*50+n::DOUBLE/t1*50,100)')} AS inventory_efficiency,
  {q('(pe-p0)/(p1-p0)*100')} AS promotion_effectiveness, {q('(rk+(ti-1)/2.0)/c*100')} AS percentile FROM x""",
)
def store_profile(t):
    return stores.store_profile(_metrics(t))


_CS = f"""{_SM}
, sc AS (SELECT store_id, av, ts, av/max(av) OVER ()*40+pe*30+cs*30 ps, pe*60+cs*40 es FROM sm)"""


@query(
    "cross_store_scores",
    "STO-5 STO-8",
    f"""{_CS}
SELECT store_id, {q('av')} AS avg_daily_sales, {q('ts')} AS total_sales, {q('ps')} AS performance_score, {q('es')} AS efficiency_score, (rank() OVER (ORDER BY ps DESC))::INT AS ranking FROM sc""",
)
def cross_store_scores(t):
    return stores.cross_store_scores(_metrics(t))


@query(
    "cross_store_summary",
    "STO-5",
    f"""{_CS}
SELECT count(*) AS stores, {q('avg(ps)')} AS average_performance, {q('max(ps)-min(ps)')} AS performance_gap, {q('max(es)-min(es)')} AS efficiency_gap, arg_max(store_id,ps) AS best_store,
  arg_min(store_id,ps) AS worst_store, {q('quantile_cont(ps,0.75)')} AS top_quartile FROM sc""",
)
def cross_store_summary(t):
    return stores.cross_store_summary(stores.cross_store_scores(_metrics(t)))


@query(
    "store_forecast_rankings",
    "STO-6 WIN-12",
    f"""
, d AS (SELECT store_id, first_category k, sale_date, sum(sale_amount) a, max(stock_hour6_22_cnt) h FROM sales GROUP BY 1,2,3),
h AS (SELECT store_id, k, {MEAN('a')} av, stddev_samp(a::DOUBLE)/{MEAN('a')} vo, {MEAN('h')}/16 sr FROM d GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY store_id, k ORDER BY sale_date DESC) dn FROM d),
f AS (SELECT store_id, k, sum(a) FILTER (WHERE dn<=7)::DOUBLE fc FROM r GROUP BY 1,2),
m AS (SELECT h.*, fc, fc/av-1 g FROM h JOIN f USING (store_id, k)),
x AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY fc DESC)+(count(*) OVER (PARTITION BY k,fc)-1)/2.0 r1, rank() OVER (PARTITION BY k ORDER BY sr)+(count(*) OVER (PARTITION BY k,sr)-1)/2.0 r2,
  rank() OVER (PARTITION BY k ORDER BY g DESC)+(count(*) OVER (PARTITION BY k,g)-1)/2.0 r3 FROM m)
SELECT store_id, k AS first_category, {q('av')} AS avg_demand, {q('vo')} AS volatility, {q('sr')} AS stockout_rate, {q('fc')} AS predicted, {q('g')} AS growth, {q('r1')} AS demand_rank, {q('r2')} AS reliability_rank,
  {q('r3')} AS growth_rank, {q('r1*0.4+r2*0.3+r3*0.3')} AS overall_score FROM x""",
)
def store_forecast_rankings(t):
    d = t.daily("store_id", "first_category", geo=False)
    recent = ranking.top_per_group(d, ["store_id", "first_category"], [F.desc("sale_date")], 7)
    forecast = recent.select("store_id", "first_category", F.col("sale_amount").cast("double").alias("forecast"))
    return stores.forecast_rankings(d, forecast, "first_category")


_BP = " UNION ALL ".join(
    f"SELECT '{n}' AS measure, {q(f'avg({c}) FILTER (WHERE av>=q75)')} AS top_mean, {q(f'avg({c}) FILTER (WHERE av<q75)')} AS rest_mean, {q(f'(avg({c}) FILTER (WHERE av>=q75)-avg({c}) FILTER (WHERE av<q75))/avg({c}) FILTER (WHERE av<q75)*100')} AS gap_pct FROM sm, c"
    for n, c in (("promo_effectiveness", "pe"), ("holiday_uplift", "hu"), ("consistency_score", "cs"), ("weekend_performance", "wp"), ("product_diversity", "pd"))
)


@query("store_best_practices", "STO-8", f"{_CUT}\n{_BP}")
def store_best_practices(t):
    return stores.best_practices(_metrics(t))
