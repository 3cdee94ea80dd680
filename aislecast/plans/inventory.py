"""Stock-out, inventory and transfer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import mean_of
from ..operators import inventory as inv
from .features import MEAN
from .registry import q, query

_LOST = """
, k AS (SELECT DISTINCT product_id FROM lines WHERE stock_hour6_22_cnt=0),
e AS (SELECT l.*, CASE WHEN stock_hour6_22_cnt>0 AND k.product_id IS NOT NULL THEN sale_amount::DOUBLE *
    (CASE WHEN stock_hour6_22_cnt<16 THEN 16::DOUBLE/(16-stock_hour6_22_cnt) ELSE 2::DOUBLE END) ELSE sale_amount::DOUBLE END est
  FROM lines l LEFT JOIN k ON k.product_id=l.product_id),
z AS (SELECT *, greatest(0::DOUBLE, est-sale_amount::DOUBLE) lost FROM e)"""


@query(
    "lost_demand_by_hours",
    "INV-1",
    f"""{_LOST}
SELECT sale_date::VARCHAR AS sale_date, store_id, product_id, {q('est')} AS estimated_demand, {q('lost')} AS lost_sales FROM z""",
)
def lost_demand_by_hours(t):
    out = inv.lost_demand_by_hours(t.lines(), ["product_id"])
    return out.select("sale_date", "store_id", "product_id", "estimated_demand", "lost_sales")


@query(
    "lost_demand_summary",
    "INV-1 AGG-2",
    f"""{_LOST}
SELECT store_id, count(*) AS total_days, count(*) FILTER (WHERE stock_hour6_22_cnt>0) AS stockout_days,
  {q('(count(*) FILTER (WHERE stock_hour6_22_cnt>0))::DOUBLE/count(*)', 2)} AS stockout_rate, {q('sum(lost)', 2)} AS total_lost_sales,
  {q('coalesce(avg(lost) FILTER (WHERE stock_hour6_22_cnt>0),0)', 2)} AS avg_lost_sales FROM z GROUP BY 1""",
    digits=2,
)
def lost_demand_summary(t):
    return inv.lost_demand_summary(inv.lost_demand_by_hours(t.lines(), ["product_id"]), ["store_id"])


@query(
    "weekday_medians",
    "INV-1 AGG-9",
    f"""
SELECT product_id, (isodow(sale_date)-1)::INT AS day_of_week, {q('median(sale_amount::DOUBLE)')} AS median_amount
FROM lines WHERE stock_hour6_22_cnt=0 GROUP BY 1,2""",
)
def weekday_medians(t):
    return inv.weekday_medians(t.lines(), ["product_id"])


@query(
    "lost_demand_by_weekday",
    "INV-2",
    f"""
, b AS (SELECT product_id, isodow(sale_date) w, {MEAN('sale_amount')} m FROM lines WHERE stock_hour6_22_cnt=0 GROUP BY 1,2)
SELECT sale_date::VARCHAR AS sale_date, store_id, l.product_id, {q('sale_amount')} AS sale_amount, {q('m')} AS estimated_demand,
  {q('CASE WHEN m IS NOT NULL THEN greatest(0::DOUBLE, m-sale_amount::DOUBLE) END')} AS lost_sales
FROM lines l LEFT JOIN b ON b.product_id=l.product_id AND b.w=isodow(sale_date) WHERE stock_hour6_22_cnt>0""",
)
def lost_demand_by_weekday(t):
    out = inv.lost_demand_by_weekday(t.lines(), ["product_id"])
    return out.select("sale_date", "store_id", "product_id", "sale_amount", "estimated_demand", "lost_sales")


@query(
    "estimate_stockout_demand",
    "INV-3 FLT-3",
    f"""
, b AS (SELECT store_id, isodow(sale_date) w, {MEAN('sale_amount')} m FROM lines
  WHERE stock_hour6_22_cnt=0 AND sale_date BETWEEN (SELECT d FROM ref)-365-28 AND (SELECT d FROM ref)-366 GROUP BY 1,2)
SELECT l.store_id, sale_date::VARCHAR AS sale_date, {q('coalesce(m,0)')} AS estimated_demand
FROM lines l LEFT JOIN b ON b.store_id=l.store_id AND b.w=isodow(sale_date)
WHERE stock_hour6_22_cnt>0 AND sale_date BETWEEN (SELECT d FROM ref)-365 AND (SELECT d FROM ref)""",
)
def estimate_stockout_demand(t):
    return inv.estimate_stockout_demand(t.lines(since=t.day(365 + 28)), ["store_id"], t.day(365), t.as_of)


_STATUS = f"""
, m AS (SELECT store_id, product_id, {MEAN('units_sold')} av, stddev_samp(units_sold::DOUBLE) sd, max(stock_level) st, min(stock_level) mn, count(*) n,
   sum(units_sold)*25.0::DOUBLE rev FROM sales GROUP BY 1,2),
s2 AS (SELECT m.*, st2.city_id, latitude, longitude, CASE WHEN sd>0 THEN av*1.5::DOUBLE ELSE av*2 END ss, st/av AS dys FROM m JOIN store st2 USING (store_id)),
status AS (SELECT *, CASE WHEN st<=ss THEN 'stockout_risk' WHEN st>av*30 THEN 'overstock' ELSE 'normal' END stat FROM s2)"""


def _status(t):
    return inv.inventory_status(t.sales(geo=False, category=False), t.store, min_rows=1)


@query(
    "inventory_status",
    "INV-5",
    f"""{_STATUS}
SELECT store_id, product_id, city_id, {q('latitude')} AS latitude, {q('longitude')} AS longitude, {q('av')} AS avg_daily_sales, {q('sd')} AS sales_stddev,
  st AS current_stock, mn AS min_stock_level, n AS days_data, {q('rev')} AS total_revenue, {q('ss')} AS safety_stock, {q("dys")} AS days_of_inventory, stat AS stock_status
FROM status""",
)
def inventory_status(t):
    return _status(t)


@query(
    "store_inventory_profile",
    "INV-6 FN-14",
    f"""
, p AS (SELECT store_id, count(DISTINCT product_id) tp, sum(stock_level)::DOUBLE/count(*) av, sum(units_sold)::DOUBLE/nullif(sum(stock_level),0) tr,
  count(*) FILTER (WHERE stock_level<=5) lo, count(*) FILTER (WHERE stock_level>units_sold*30) hi, sum(stock_level)*25.0::DOUBLE iv FROM sales GROUP BY 1 HAVING count(*)>=30)
SELECT store_id, tp AS total_products, {q('av')} AS avg_stock_level, {q('tr')} AS turnover, lo AS low_stock_products, hi AS overstock_products,
  {q('iv')} AS inventory_value, {q('CASE WHEN tr>0.1 AND lo<tp*0.1 THEN 90+tr*100 WHEN tr>0.05 THEN 70+tr*200 ELSE 50 END')} AS efficiency_score FROM p""",
)
def store_inventory_profile(t):
    return inv.store_profiles(t.sales(geo=False, category=False))


_TRANSFER = f"""{_STATUS}
, pr AS (SELECT a.store_id src, b.store_id tgt, a.product_id, a.city_id, a.dys da, b.dys db, b.av bav,
   6371.0::DOUBLE*2*atan2(sqrt(hv), sqrt(1-hv))*0.5::DOUBLE cost, least(greatest(0::DOUBLE, a.st-a.ss), greatest(0::DOUBLE, b.ss-b.st)) qty
  FROM (SELECT a.*, b AS b, pow(sin((radians(b.latitude)-radians(a.latitude))/2),2)+cos(radians(a.latitude))*cos(radians(b.latitude))*pow(sin((radians(b.longitude)-radians(a.longitude))/2),2) hv,
      a AS a FROM status a JOIN status b ON a.product_id=b.product_id AND a.store_id<>b.store_id
      WHERE a.stat='overstock' AND a.dys>30 AND b.stat='stockout_risk' AND b.dys<3)),
sc AS (SELECT *, greatest(0, least(100, greatest(0,(3-db)*10)+greatest(0,(da-30)*2)+qty*25/greatest(cost,1)*10-least(20,cost*0.2))) score FROM pr WHERE cost<=100 AND qty>=5),
tr AS (SELECT *, least(qty, bav*7)*25 rev, CASE WHEN db<=1 THEN 5 WHEN db<=2 THEN 4 WHEN db<=3 THEN 3 WHEN da>45 THEN 3 ELSE 2 END urg FROM sc WHERE score>=60),
transfers AS (SELECT *, CASE WHEN urg>=4 AND score>=80 THEN 'immediate' WHEN urg>=3 AND score>=70 THEN 'high' WHEN score>=60 OR rev>=500 THEN 'medium' ELSE 'low' END prio FROM tr)"""
_TR_COLS = f"""src AS source_store_id, tgt AS target_store_id, product_id, city_id, trunc(qty)::BIGINT AS quantity, {q('score')} AS optimization_score,
  {q('rev')} AS revenue_impact, {q('cost')} AS transfer_cost, urg::INT AS urgency_level, prio AS priority, {q('rev/greatest(cost,1)')} AS roi"""


@query("transfer_opportunities", "INV-7 INV-8 JN-11 JN-12 FN-19 FN-21", f"{_TRANSFER}\nSELECT {_TR_COLS} FROM transfers")
def transfer_opportunities(t):
    return inv.transfer_opportunities(_status(t))


@query(
    "transfer_top",
    "INV-8 SRT-4",
    f"""{_TRANSFER}
, o AS (SELECT *, row_number() OVER (ORDER BY CASE prio WHEN 'immediate' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, score DESC, rev DESC, src, tgt, product_id) AS place FROM transfers)
SELECT {_TR_COLS} FROM o WHERE place<=50""",
)
def transfer_top(t):
    return inv.top_transfers(inv.transfer_opportunities(_status(t)))


@query(
    "transfer_store_summary",
    "INV-9 SET-1",
    f"""{_TRANSFER}
, r AS (SELECT src AS store_id, 'source' AS role, rev, prio FROM transfers UNION ALL SELECT tgt, 'target', rev, prio FROM transfers)
SELECT store_id, count(*) AS total_opportunities, count(*) FILTER (WHERE role='source') AS as_source, count(*) FILTER (WHERE role='target') AS as_target,
  {q('sum(rev)')} AS total_potential_revenue, count(*) FILTER (WHERE prio IN ('immediate','high')) AS high_priority_count FROM r GROUP BY 1""",
)
def transfer_store_summary(t):
    return inv.store_transfer_summary(inv.transfer_opportunities(_status(t)))


@query(
    "transfer_city_overview",
    "INV-9 AGG-23",
    f"""{_TRANSFER}
SELECT city_id, count(*) AS total_opportunities, count(DISTINCT src) AS stores_with_excess, count(DISTINCT tgt) AS stores_with_shortage,
  count(DISTINCT product_id) AS products_affected, sum(trunc(qty)::BIGINT)::BIGINT AS total_units, {q('sum(rev)')} AS total_revenue_potential,
  {q('avg(score)')} AS avg_score, count(*) FILTER (WHERE prio='immediate') AS immediate_count, count(*) FILTER (WHERE prio='high') AS high_count
FROM transfers GROUP BY 1""",
)
def transfer_city_overview(t):
    return inv.city_transfer_overview(inv.transfer_opportunities(_status(t)))


@query(
    "stock_balance_scores",
    "INV-10",
    f"""{_STATUS}
, c AS (SELECT city_id, product_id, count(*) FILTER (WHERE stat='overstock') s, count(*) FILTER (WHERE stat='stockout_risk') d FROM status GROUP BY 1,2)
SELECT city_id, product_id, s AS surplus_stores, d AS deficit_stores,
  {q('greatest(0,least(100, least(s::DOUBLE/d, d::DOUBLE/s)*50+least(s+d,10)*3))')} AS balance_score FROM c WHERE s>0 AND d>0""",
)
def stock_balance_scores(t):
    return inv.balance_scores(_status(t))


_SERIES = """
, d AS (SELECT city_id, first_category, sale_date, sum(sale_amount) a, max(stock_hour6_22_cnt) h, max(stock_level) sl,
   bool_or(activity_flag) pf, bool_or(holiday_flag) hf FROM sales GROUP BY 1,2,3),
r AS (SELECT *, row_number() OVER w dn, row_number() OVER (PARTITION BY city_id, first_category ORDER BY sale_date) up,
   (a-lag(a) OVER (PARTITION BY city_id, first_category ORDER BY sale_date))::DOUBLE/lag(a::DOUBLE) OVER (PARTITION BY city_id, first_category ORDER BY sale_date) pc
  FROM d WINDOW w AS (PARTITION BY city_id, first_category ORDER BY sale_date DESC))"""
_KEYS = ["city_id", "first_category"]
_RISK = f"""{_SERIES}
, g AS (SELECT city_id, first_category, count(*) n, (count(*) FILTER (WHERE h>0))::DOUBLE/count(*) fr, coalesce(avg(pc) FILTER (WHERE dn<=13),0) tr,
   coalesce(stddev_samp(a::DOUBLE) FILTER (WHERE dn<=14)/{MEAN('a', 'dn<=14')},0) vol, 1-{MEAN('h', 'dn<=14')}/16 px, {MEAN('a')} m, stddev_samp(a::DOUBLE) s,
   {MEAN('a', 'dn<=7')} m7, coalesce(avg(pc) FILTER (WHERE dn<=6),0) t7, 1-{MEAN('h', 'dn<=7')}/16 p7 FROM r GROUP BY 1,2 HAVING count(*)>=30),
x AS (SELECT *, greatest(0,tr) u, CASE WHEN m7>0 THEN CASE WHEN t7>0 THEN p7*m7*7/(m7*(1+t7)) ELSE p7*m7*7/m7 END END dd FROM g),
risk AS (SELECT *, fr*0.3+(1-px)*0.25+vol*0.2+u*0.15+u*2*0.1 sc, greatest(1.64*s*sqrt(3.0::DOUBLE), m*0.1) ss FROM x),
lev AS (SELECT *, CASE WHEN sc>=0.8 THEN 'critical' WHEN sc>=0.6 THEN 'high' WHEN sc>=0.4 THEN 'medium' WHEN sc>=0.2 THEN 'low' ELSE 'minimal' END lv FROM risk)"""


def _risk(t):
    return inv.assess_risk(t.daily(*_KEYS), _KEYS)


@query(
    "stockout_risk",
    "INV-11 INV-12 INV-13 WIN-9",
    f"""{_RISK}
SELECT city_id, first_category, n AS "rows", {q('fr')} AS stockout_frequency, {q('tr')} AS recent_trend, {q('vol')} AS demand_volatility, {q('px')} AS stock_proxy,
  {q('u*2')} AS lead_time_risk, {q('sc')} AS risk_score, {q('ss')} AS safety_stock, CASE WHEN dd>0 THEN greatest(1, trunc(dd))::BIGINT END AS days_until_stockout,
  lv AS risk_level FROM lev""",
)
def stockout_risk(t):
    return _risk(t)


@query(
    "reorder_list",
    "INV-14 INV-21",
    f"""{_RISK}
SELECT city_id, first_category, CASE WHEN lv='critical' THEN 'immediate' ELSE 'high' END AS urgency, lv AS risk_level, {q('ss*2')} AS reorder_quantity,
  CASE WHEN dd>0 THEN greatest(1, trunc(dd))::BIGINT END AS days_until_stockout, {q('sc')} AS risk_score FROM lev WHERE lv IN ('critical','high')""",
)
def reorder_list(t):
    return inv.reorder_list(_risk(t), _KEYS)


@query(
    "early_warnings",
    "INV-14 CMB-5",
    f"""{_RISK}
SELECT city_id, first_category, 'critical_stockout_risk' AS alert_type, 'critical' AS severity, {q('sc')} AS value FROM lev WHERE lv='critical'
UNION ALL SELECT city_id, first_category, 'high_demand_volatility', 'warning', {q('vol')} FROM lev WHERE vol>1
UNION ALL SELECT city_id, first_category, 'rapid_demand_increase', 'warning', {q('tr')} FROM lev WHERE tr>0.2""",
)
def early_warnings(t):
    return inv.early_warnings(_risk(t), _KEYS)


@query(
    "store_allocation",
    "INV-15 INV-21",
    f"""
, d AS (SELECT store_id, first_category, sale_date, sum(sale_amount) a, max(stock_hour6_22_cnt) h FROM sales GROUP BY 1,2,3),
m AS (SELECT store_id, first_category, {MEAN('a')} av, (count(*) FILTER (WHERE h>0))::DOUBLE/count(*) + coalesce(stddev_samp(a::DOUBLE)/{MEAN('a')},0) rk
  FROM d GROUP BY 1,2 HAVING count(*)>=10)
SELECT store_id, first_category, {q('av')} AS avg_demand, {q('rk')} AS risk_score,
  {q('av*(1+rk*0.2)/sum(av*(1+rk*0.2)) OVER (PARTITION BY first_category)*100')} AS allocation_pct FROM m""",
)
def store_allocation(t):
    return inv.allocate_across_stores(t.daily("store_id", "first_category", geo=False), "first_category")


_LIFT = "coalesce(greatest(0, least(({a}-{b})/{b}*{k}, 1)), 0.1)"


@query(
    "weighted_stockout_risk",
    "INV-16",
    f"""{_SERIES}
, g AS (SELECT city_id, first_category, count(*) n, {MEAN('a')} av, stddev_samp(a::DOUBLE) sd, {MEAN('sl')} st, min(sl) mn, {MEAN('a', 'dn<=7')} nw, {MEAN('a', 'up<=7')} od,
   {MEAN('a', 'dn<=3')} l3, {MEAN('a', 'pf')} pa, {MEAN('a', 'NOT pf')} pr, {MEAN('a', 'hf')} ha, {MEAN('a', 'NOT hf')} hr FROM r GROUP BY 1,2),
f AS (SELECT *, coalesce(least(greatest(0,(st-mn)/st),1),0.5) f1, coalesce(least(sd/av/2,1),0.2) f2,
   CASE WHEN n>=7 THEN coalesce(least(greatest(0,(nw-od)/od)*0.5,1),0.1) ELSE 0.1 END f3, {_LIFT.format(a='pa', b='pr', k='0.3')} f4, {_LIFT.format(a='ha', b='hr', k='0.2')} f5 FROM g),
s AS (SELECT *, least((f1*0.3+f2*0.25+f3*0.2+f4*0.15+f5*0.1)*100, 100) s0 FROM f),
z AS (SELECT *, CASE WHEN n>=3 AND l3>av*1.2 THEN least(s0*1.3,100) ELSE s0 END rs FROM s),
w AS (SELECT *, trunc(av*7*(1+rs/100))::BIGINT tg, isodow((SELECT d FROM ref)+1)>=6 w1 FROM z)
SELECT city_id, first_category, n AS "rows", {q('av')} AS avg_sales, {q('f1')} AS low_stock, {q('f2')} AS demand_variance, {q('f3')} AS demand_trend, {q('f4')} AS promotion_impact,
  {q('f5')} AS seasonal, {q('rs')} AS risk_score, trunc(av*3)::BIGINT AS min_stock,
  CASE WHEN w1 THEN trunc(tg*1.2::DOUBLE)::BIGINT ELSE tg END AS target_week_1,
  CASE WHEN w1 THEN trunc(trunc(tg*1.5::DOUBLE)*1.2::DOUBLE)::BIGINT ELSE trunc(tg*1.5::DOUBLE)::BIGINT END AS max_week_1,
  CASE WHEN w1 THEN trunc(tg*1.2::DOUBLE)::BIGINT ELSE tg END AS target_week_2,
  CASE WHEN w1 THEN trunc(trunc(tg*1.5::DOUBLE)*1.2::DOUBLE)::BIGINT ELSE trunc(tg*1.5::DOUBLE)::BIGINT END AS max_week_2 FROM w""",
)
def weighted_stockout_risk(t):
    return inv.weighted_risk(t.daily(*_KEYS), _KEYS, t.as_of)


_POS = f"""
, g AS (SELECT city_id, store_id, product_id, ((city_id*31+store_id*7)%100)/100.0::DOUBLE b, arg_max(stock_hour6_22_cnt, sale_date) rh,
   count(*) FILTER (WHERE x30) n30, {MEAN('sale_amount', 'x30')} a30, {MEAN('hh', 'x30')} h30, (count(*) FILTER (WHERE x30 AND hh=0))::DOUBLE/nullif(count(*) FILTER (WHERE x30),0) av30,
   count(*) FILTER (WHERE x90) n90, (count(*) FILTER (WHERE x90 AND hh>0))::DOUBLE/nullif(count(*) FILTER (WHERE x90),0) f90, {MEAN('hh', 'x90')} h90,
   count(*) FILTER (WHERE x90 AND hh>8) s90, max(sale_date) FILTER (WHERE x90 AND hh>0) ls,
   count(*) FILTER (WHERE x60) n60, {MEAN('sale_amount', 'x60')} a60, {MEAN('hh', 'x60')} h60, {MEAN('sale_amount', 'x60 AND hh=0')} a60s, {MEAN('sale_amount', 'x60 AND hh>0')} a60o
  FROM (SELECT *, stock_hour6_22_cnt hh, sale_date>=(SELECT d FROM ref)-30 x30, sale_date>=(SELECT d FROM ref)-60 AND sale_amount>0 x60, sale_date>=(SELECT d FROM ref)-90 x90 FROM sales)
  GROUP BY 1,2,3),
p1 AS (SELECT *, greatest(1::DOUBLE, a30/5::DOUBLE) dd FROM g),
p2 AS (SELECT *, trunc(dd*(7+av30*14)) bs FROM p1),
p3 AS (SELECT *, CASE WHEN rh>12 THEN greatest(trunc(dd*2), bs-trunc(dd*3)) WHEN rh>6 THEN greatest(trunc(dd*3), bs-trunc(dd*2)) ELSE bs END es FROM p2),
p4 AS (SELECT *, CASE WHEN n30>0 THEN greatest(trunc(dd), trunc(es*(1+h30/16*0.3::DOUBLE)*((product_id%100)/100.0::DOUBLE*0.4::DOUBLE+0.8::DOUBLE)*(b*0.3::DOUBLE+0.85::DOUBLE)))
    ELSE greatest(15, trunc((30+product_id%40)*((city_id%10)*0.1::DOUBLE+0.9::DOUBLE)*((store_id%15)*0.05::DOUBLE+0.95::DOUBLE))) END::BIGINT stock,
  least(1::DOUBLE, CASE WHEN n90>0 THEN (f90+CASE WHEN s90>0 THEN s90::DOUBLE/n90*0.5::DOUBLE ELSE 0::DOUBLE END)*(CASE WHEN h90>8 THEN 1.3::DOUBLE WHEN h90>4 THEN 1.1::DOUBLE ELSE 1::DOUBLE END)
      *((product_id%20)/20.0::DOUBLE*0.3::DOUBLE+0.85::DOUBLE)*(b*0.2::DOUBLE+0.9::DOUBLE)
    ELSE 0.05::DOUBLE*((product_id%15)/15.0::DOUBLE*0.4::DOUBLE+0.8::DOUBLE)*(b*0.2::DOUBLE+0.9::DOUBLE) END) fq,
  greatest(1::DOUBLE, CASE WHEN n60>0 THEN (CASE WHEN a60s>0 THEN CASE WHEN a60o>0 THEN a60s/5*(1+h60/16*0.5::DOUBLE) ELSE a60s/5 END ELSE a60/5 END)
      *((product_id%50)/50.0::DOUBLE*0.6::DOUBLE+0.7::DOUBLE)*(b*0.4::DOUBLE+0.8::DOUBLE)
    ELSE 8::DOUBLE*((product_id%30)/30.0::DOUBLE*0.8::DOUBLE+0.6::DOUBLE)*(b*0.4::DOUBLE+0.8::DOUBLE) END) dm FROM p3),
pos AS (SELECT *, greatest(0, least(1, (CASE WHEN stock/greatest(dm,1)<=1 THEN 0.9::DOUBLE WHEN stock/greatest(dm,1)<=3 THEN 0.7 WHEN stock/greatest(dm,1)<=7 THEN 0.5 WHEN stock/greatest(dm,1)<=14 THEN 0.3 ELSE 0.1 END)*0.7::DOUBLE
   + least(fq*2,1)*0.3::DOUBLE)) rs, stock/greatest(dm,1) cover FROM p4)"""


def _position(t):
    bucket = (F.col("city_id") * 31 + F.col("store_id") * 7) % 100
    return inv.demand_position(t.lines(since=t.day(90)), t.store, t.as_of, bucket=bucket, keys=t.pairs())


@query(
    "demand_position",
    "INV-17 INV-18 FN-25",
    f"""{_POS}
SELECT city_id, store_id, product_id, ls::VARCHAR AS last_stockout, stock AS current_stock, {q('fq')} AS stockout_frequency, {q('dm')} AS avg_daily_demand, {q('rs')} AS risk_score,
  trunc(stock/dm)::BIGINT AS days_until_stockout, greatest(50, trunc(dm*30)::BIGINT+trunc(dm*7*(1+fq))::BIGINT)::BIGINT AS reorder_quantity FROM pos""",
)
def demand_position(t):
    return _position(t)


@query(
    "demand_insights",
    "INV-19 SRT-4",
    f"""{_POS}
SELECT city_id, store_id, product_id, {q('rs')} AS risk_score, CASE WHEN rs>=0.8 THEN 'critical' WHEN rs>=0.6 THEN 'high' WHEN rs>=0.4 THEN 'medium' ELSE 'low' END AS urgency,
  {q('dm*30')} AS month_demand, {q('dm*7*fq*5')} AS estimated_lost_sales FROM pos""",
)
def demand_insights(t):
    return inv.demand_insights(_position(t))


_COVER = "(CASE WHEN cover<=3 THEN 0.9::DOUBLE WHEN cover<=7 THEN 0.7 WHEN cover<=14 THEN 0.5 ELSE 0.3 END)"


@query(
    "portfolio_risk",
    "INV-19",
    f"""{_POS}
SELECT count(*) AS keys, {q(f'avg({_COVER})')} AS overall_risk, count(*) FILTER (WHERE cover<=7) AS high_risk_keys FROM pos""",
)
def portfolio_risk(t):
    return inv.portfolio_risk(_position(t))


@query(
    "risk_timeline",
    "INV-19",
    f"""{_POS}
SELECT ((SELECT d FROM ref)+trunc(cover)::INT)::VARCHAR AS stockout_date, count(*) AS keys, {q('sum(dm*50)')} AS estimated_impact FROM pos WHERE cover<=30 GROUP BY 1""",
)
def risk_timeline(t):
    return inv.risk_timeline(_position(t), t.as_of)


@query(
    "location_risk",
    "INV-19",
    f"""
SELECT city_id, store_id, {q(MEAN('stock_hour6_22_cnt'))} AS avg_stockout_hours, {q('(count(*) FILTER (WHERE stock_hour6_22_cnt>8))::DOUBLE/count(*)')} AS severe_rate, count(*) AS "rows"
FROM sales WHERE sale_date>=(SELECT d FROM ref)-60 GROUP BY 1,2""",
)
def location_risk(t):
    return inv.location_risk(t.sales(category=False, since=t.day(60)))


@query(
    "supply_against_lead_time",
    "INV-20",
    f"""{_STATUS}
, b AS (SELECT store_id, product_id, st, av, CASE WHEN av>0 THEN st/av ELSE 14 END ds, (st*7%60+20)::DOUBLE base, av*7*(95/100::DOUBLE) sf FROM status),
k AS (SELECT *, CASE WHEN ds<7 THEN least(100, base*1.5) WHEN ds<14 THEN base ELSE greatest(10, base*0.7) END rk FROM b)
SELECT store_id, product_id, {q('ds')} AS days_of_supply, {q('rk')} AS risk, CASE WHEN rk>80 THEN 'Critical' WHEN rk>60 THEN 'High' WHEN rk>40 THEN 'Medium' ELSE 'Low' END AS risk_class,
  {q('sf')} AS safety_units, trunc(av*7+sf)::BIGINT AS reorder_units FROM k""",
)
def supply_against_lead_time(t):
    # the base risk of 20..79 comes from the stock level; any risk column can be given
    base = (F.col("current_stock") * 7 % 60 + 20).cast("double")
    out = inv.supply_against_lead_time(_status(t), base)
    return out.select("store_id", "product_id", "days_of_supply", "risk", "risk_class", "safety_units", "reorder_units")


@query(
    "forecast_allocation",
    "INV-22 FC-12",
    f"""
, d AS (SELECT store_id, first_category, sale_date, sum(units_sold)::BIGINT u FROM sales GROUP BY 1,2,3),
f AS (SELECT store_id, first_category, {MEAN('u')} m, {MEAN('u')}+1.96::DOUBLE*coalesce(stddev_samp(u::DOUBLE),0) up FROM d GROUP BY 1,2),
p AS (SELECT first_category, sum(m) pd, sum((up-m)*0.95::DOUBLE) ss FROM f GROUP BY 1)
SELECT first_category, {q('pd')} AS predicted_demand, {q('ss')} AS safety_stock, {q('pd+ss')} AS recommended_stock, {q('pd/(pd+ss)')} AS turnover, {q('(pd+ss)*0.02')} AS holding_cost FROM p""",
)
def forecast_allocation(t):
    d = t.daily("store_id", "first_category", geo=False)
    f = d.groupBy("store_id", "first_category").agg(
        mean_of("units_sold").alias("forecast"),
        (mean_of("units_sold") + 1.96 * F.coalesce(F.stddev_samp(F.col("units_sold").cast("double")), F.lit(0.0))).alias("upper"),
    )
    return inv.allocate_forecast(f, "first_category")


@query(
    "stockout_base",
    "CMB-1",
    f"""
, ev AS (SELECT store_id, product_id, sale_date, stock_hour6_22_cnt du, sale_amount::DOUBLE*stock_hour6_22_cnt/16 ls FROM lines WHERE stock_hour6_22_cnt>0)
SELECT l.store_id, l.product_id, l.sale_date::VARCHAR AS sale_date, {q('sale_amount')} AS sale_amount, coalesce(du,0)::BIGINT AS stockout_duration, {q('coalesce(ls,0)')} AS lost_sales,
  stock_hour6_22_cnt>0 AS had_stockout FROM lines l LEFT JOIN ev ON ev.store_id=l.store_id AND ev.product_id=l.product_id AND ev.sale_date=l.sale_date""",
)
def stockout_base(t):
    s = t.lines()
    out = inv.stockout_base(s, t.stockout_events(s))
    return out.select("store_id", "product_id", "sale_date", "sale_amount", "stockout_duration", "lost_sales", "had_stockout")


