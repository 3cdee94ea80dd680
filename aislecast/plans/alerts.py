"""Alert queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import alerts
from .features import MEAN
from .registry import corr_sql, q, query

_C = ", ".join(f"{q(c)} AS {c}" for c in ("current_value", "impact_score", "revenue_impact"))
_OUT = f"alert_type, severity, store_id, item, {_C}, urgency_level::INT AS urgency_level"

_LOW = f"""
, lg AS (SELECT store_id, product_id, {MEAN('units_sold')} av, max(stock_level) st FROM sales WHERE sale_date>=(SELECT d FROM ref)-365 GROUP BY 1,2),
lx AS (SELECT *, st/greatest(av,1) dy FROM lg WHERE st>0 AND av>0),
a1 AS (SELECT 'stockout' AS alert_type, CASE WHEN dy<=1 THEN 'critical' WHEN dy<=2 THEN 'high' WHEN dy<=3 THEN 'medium' ELSE 'low' END AS severity, store_id,
  product_id::VARCHAR AS item, dy AS current_value, least(100::DOUBLE,(6-dy)*20) AS impact_score, CASE WHEN dy<=2 THEN 5 ELSE 4 END AS urgency_level, av*10*25 AS revenue_impact FROM lx WHERE dy<=5)"""


def _low(t):
    return alerts.low_stock(t.sales(geo=False, category=False, since=t.day(365)), min_rows=1)


@query("alert_low_stock", "ALR-1 FN-14", f"{_LOW}\nSELECT {_OUT} FROM a1")
def alert_low_stock(t):
    return _low(t)


_B = "OVER (PARTITION BY store_id, first_category ORDER BY sale_date ROWS BETWEEN 21 PRECEDING AND 8 PRECEDING)"
_ANOM = f"""
, ad AS (SELECT store_id, first_category, sale_date, sum(units_sold)::BIGINT u FROM sales WHERE sale_date>=(SELECT d FROM ref)-730 GROUP BY 1,2,3),
az AS (SELECT *, sum(u) {_B}::DOUBLE/nullif(count(u) {_B},0) m, stddev_samp(u::DOUBLE) {_B} s FROM ad),
ay AS (SELECT *, (u-m)/s z FROM az WHERE s>0),
ax AS (SELECT * FROM ay WHERE sale_date>=(SELECT d FROM ref)-90 AND abs(z)>=2),
a2 AS (SELECT CASE WHEN z>0 THEN 'demand_spike' ELSE 'anomaly_detection' END AS alert_type, CASE WHEN abs(z)>=4 THEN 'critical' WHEN abs(z)>=3 THEN 'high' WHEN abs(z)>=2.5 THEN 'medium' ELSE 'low' END AS severity,
  store_id, first_category AS item, abs(z) AS current_value, least(100::DOUBLE,abs(z)*25) AS impact_score, least(5,floor(abs(z)))::INT AS urgency_level, abs(u-m)*25 AS revenue_impact, sale_date FROM ax)"""


def _anomalies(t):
    d = t.daily("store_id", "first_category", geo=False, since=t.day(730))
    return alerts.demand_anomalies(d, t.day(90), "first_category")


@query("alert_demand_anomaly", "ALR-2 WIN-4", f"{_ANOM}\nSELECT {_OUT} FROM a2")
def alert_demand_anomaly(t):
    return _anomalies(t)


_WEA = f"""
, wg AS (SELECT store_id, first_category, {corr_sql('units_sold', 'avg_temperature')} ct, {corr_sql('units_sold', 'avg_humidity')} ch, {corr_sql('units_sold', 'precpt')} cp,
  {MEAN('units_sold')} av, avg(avg_temperature) tm, stddev_samp(avg_temperature) sd FROM sales WHERE sale_date>=(SELECT d FROM ref)-730 GROUP BY 1,2 HAVING count(*)>=30),
wn AS (SELECT DISTINCT store_id, first_category, sale_date, avg_temperature nw FROM sales WHERE sale_date>=(SELECT d FROM ref)-30),
wz AS (SELECT wg.*, abs((nw-tm)/sd) z FROM wg JOIN wn USING (store_id, first_category) WHERE (abs(ct)>=0.3 OR abs(ch)>=0.3 OR abs(cp)>=0.3) AND sd>0),
a3 AS (SELECT 'weather_impact' AS alert_type, CASE WHEN z>=3 THEN 'medium' ELSE 'low' END AS severity, store_id, first_category AS item, z AS current_value, least(100::DOUBLE,abs(ct)*100) AS impact_score,
  CASE WHEN z>=3 THEN 3 ELSE 2 END AS urgency_level, abs(ct)*z*av*0.2*25 AS revenue_impact FROM wz WHERE z>=1.2)"""


def _weather(t):
    s = t.sales(since=t.day(730))
    return alerts.weather_impacts(s, t.sales(since=t.day(30)), "first_category", min_z=1.2)


@query("alert_weather_impact", "ALR-3 AGG-5", f"{_WEA}\nSELECT {_OUT} FROM a3")
def alert_weather_impact(t):
    return _weather(t)


_PRO = f"""
, pg AS (SELECT store_id, first_category, {MEAN('units_sold')} av, max(stock_level) st, {MEAN('units_sold', 'discount>0')} p, {MEAN('units_sold', 'discount=0')} r FROM sales
  WHERE sale_date>=(SELECT d FROM ref)-730 GROUP BY 1,2 HAVING count(*)>=30 AND count(*) FILTER (WHERE discount>0)>=5),
pl AS (SELECT *, CASE WHEN p IS NOT NULL AND r>0 THEN p/r ELSE 1 END lf FROM pg WHERE st>av*5),
a4 AS (SELECT 'promotion_opportunity' AS alert_type, 'medium' AS severity, store_id, first_category AS item, st/greatest(av,1) AS current_value, least(100::DOUBLE,(lf-1)*100) AS impact_score,
  2 AS urgency_level, (lf-1)*av*7*25 AS revenue_impact FROM pl WHERE lf>=1.2 AND st/greatest(av,1)>6)"""


def _promo(t):
    s = t.sales(geo=False, since=t.day(730))
    return alerts.promotion_opportunities(s, "first_category", cover=5, min_days=6)


@query("alert_promotion_opportunity", "ALR-4", f"{_PRO}\nSELECT {_OUT} FROM a4")
def alert_promotion_opportunity(t):
    return _promo(t)


_DEC = f"""
, dg AS (SELECT store_id, {MEAN('units_sold', 'nw')} ra, {MEAN('units_sold', 'od')} ba, (sum(units_sold) FILTER (WHERE nw))*25.0::DOUBLE rr, (sum(units_sold) FILTER (WHERE od))*25.0::DOUBLE br
  FROM (SELECT *, sale_date>=(SELECT d FROM ref)-30 nw, sale_date BETWEEN (SELECT d FROM ref)-120 AND (SELECT d FROM ref)-30 od FROM lines WHERE sale_date>=(SELECT d FROM ref)-120)
  GROUP BY 1 HAVING count(*)>=20),
dx AS (SELECT *, (ra-ba)/ba ch FROM dg WHERE ba>0),
a5 AS (SELECT 'performance_decline' AS alert_type, CASE WHEN abs(ch)>=0.3 THEN 'critical' WHEN abs(ch)>=0.2 THEN 'high' WHEN abs(ch)>=0.15 THEN 'medium' ELSE 'low' END AS severity, store_id, NULL::VARCHAR AS item,
  abs(ch) AS current_value, least(100::DOUBLE,abs(ch)*200) AS impact_score, CASE WHEN abs(ch)>=0.25 THEN 4 ELSE 3 END AS urgency_level, coalesce(br-rr,0) AS revenue_impact FROM dx WHERE ch<=-0.15)"""


def _decline(t):
    return alerts.store_declines(t.lines(since=t.day(120)), t.as_of, recent=30, span=120)


@query("alert_store_decline", "ALR-5", f"{_DEC}\nSELECT {_OUT} FROM a5")
def alert_store_decline(t):
    return _decline(t)


_MERGED = f"""{_LOW}{_ANOM}{_WEA}{_PRO}{_DEC}
, u AS (SELECT * FROM a1 UNION ALL SELECT * EXCLUDE (sale_date) FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4 UNION ALL SELECT * FROM a5),
m AS (SELECT *, row_number() OVER (PARTITION BY store_id, item, alert_type ORDER BY impact_score DESC, urgency_level DESC, current_value DESC) rn FROM u)"""


def _monitors(t):
    return [_low(t), _anomalies(t), _weather(t), _promo(t), _decline(t)]


@query(
    "alerts_top",
    "ALR-6 WIN-15 SET-2",
    f"""{_MERGED}
SELECT {_OUT} FROM m WHERE rn=1 ORDER BY impact_score DESC, urgency_level DESC, alert_type, store_id, item NULLS FIRST LIMIT 50""".replace(
        "ORDER BY impact_score DESC, urgency_level DESC, alert_type", "ORDER BY m.impact_score DESC, m.urgency_level DESC, m.alert_type"
    ),
)
def alerts_top(t):
    return alerts.merge_alerts(_monitors(t))


@query(
    "alerts_summary",
    "ALR-6 AGG-21",
    f"""{_MERGED}
SELECT alert_type, severity, count(*) AS alert_count, {q('avg(impact_score)')} AS avg_impact, {q('sum(revenue_impact)')} AS total_revenue_impact FROM m WHERE rn=1 GROUP BY 1,2""",
)
def alerts_summary(t):
    return alerts.alert_summary(alerts.merge_alerts(_monitors(t), top=None))


@query(
    "alert_dashboard",
    "AGG-21",
    f"""
, l AS (SELECT event_type AS alert_type, CASE WHEN value>=50 THEN 'high' ELSE 'low' END AS severity, ts AS created_at, value AS impact_score, user_id%2=0 AS ack,
  CASE WHEN user_id%2=0 THEN ts + to_hours((event_id%48)::INT) END AS ackat, event_id%3=0 AS res FROM events)
SELECT alert_type, severity, count(*) AS alert_count, {q('avg(impact_score)')} AS avg_impact, count(*) FILTER (WHERE ack) AS acknowledged, count(*) FILTER (WHERE res) AS resolved,
  {q('avg((event_hours))')} AS avg_response_hours, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS latest_alert
FROM (SELECT *, (epoch(date_trunc('second', ackat))-epoch(date_trunc('second', created_at)))/3600 AS event_hours FROM l) WHERE created_at >= (SELECT max(ts)::DATE FROM events) - INTERVAL 7 DAY GROUP BY 1,2""",
)
def alert_dashboard(t):
    # the event table serves as a stored alert log
    ev = t.raw("events")
    ack = F.col("user_id") % 2 == 0
    log = ev.select(
        F.col("event_type").alias("alert_type"),
        F.when(F.col("value") >= 50, "high").otherwise("low").alias("severity"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("impact_score"),
        ack.alias("is_acknowledged"),
        F.when(ack, F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 48).cast("int"))).alias("acknowledged_at"),
        F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("open").alias("resolution_status"),
    )
    last: dt.date = ev.agg(F.max("ts").cast("date")).first()[0]
    return alerts.alert_dashboard(log, last)
