"""Customer and competition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import competition as cmp
from ..operators import customers as cus
from .features import MEAN
from .registry import q, query

_PUR = """
, pu AS (SELECT o_custkey c, l_suppkey s, p_type k, CAST(l_shipdate AS DATE) d, CAST(l_extendedprice AS DECIMAL(12,2)) v FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey),
rf AS (SELECT c, count(*) f, sum(v) m, sum(v)::DOUBLE/count(*) av, ((SELECT d FROM ref)-max(d))::INT r, count(DISTINCT k) cd, count(DISTINCT s) sl, stddev_samp(v::DOUBLE) sd FROM pu GROUP BY 1 HAVING count(*)>=5),
sc AS (SELECT *, CASE WHEN r<=7 THEN 5 WHEN r<=14 THEN 4 WHEN r<=30 THEN 3 WHEN r<=60 THEN 2 ELSE 1 END rs, CASE WHEN f>=20 THEN 5 WHEN f>=15 THEN 4 WHEN f>=10 THEN 3 WHEN f>=5 THEN 2 ELSE 1 END fs,
  CASE WHEN m>=2000000 THEN 5 WHEN m>=1000000 THEN 4 WHEN m>=500000 THEN 3 WHEN m>=200000 THEN 2 ELSE 1 END ms FROM rf)"""


def purchases(t):
    li = t.raw("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice")
    o = t.raw("orders").select("o_orderkey", "o_custkey")
    p = t.raw("part").select("p_partkey", "p_type")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(p, li.l_partkey == p.p_partkey)
        .select(
            F.col("o_custkey").alias("customer_id"),
            F.col("l_suppkey").alias("store_id"),
            F.col("p_type").alias("category"),
            F.col("l_shipdate").cast("date").alias("day"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("value"),
        )
    )


MONEY = (2000000, 1000000, 500000, 200000)


def scored(t):
    return cus.rfm(purchases(t), t.as_of, money=MONEY)


@query(
    "customer_rfm",
    "CUS-1",
    f"""{_PUR}
SELECT c AS customer_id, f AS frequency, {q('m')} AS monetary_value, {q('av')} AS avg_value, r AS recency_days, cd AS category_diversity, sl AS store_loyalty, {q('sd')} AS spending_std,
  rs AS recency_score, fs AS frequency_score, ms AS monetary_score FROM sc""",
)
def customer_rfm(t):
    return scored(t)


_SEG = f"""{_PUR}
, sg AS (SELECT rs*100+fs*10+ms AS code, * FROM sc),
ng AS (SELECT code, count(*) n, avg(rs) r, avg(fs) f, avg(ms) m, (count(*) FILTER (WHERE sg.r>30))::DOUBLE/count(*) ch, sum(sg.m) lv FROM sg GROUP BY 1),
nm AS (SELECT *, CASE WHEN r>=4 AND f>=4 AND m>=4 THEN 'VIP Champions' WHEN r>=3 AND f>=4 AND m>=3 THEN 'Loyal Customers' WHEN r>=4 AND f<3 AND m>=4 THEN 'Big Spenders' WHEN r>=4 AND f>=3 AND m<3 THEN 'Potential Loyalists'
  WHEN r<3 AND f>=4 AND m>=3 THEN 'At Risk Loyal' WHEN r<3 AND f<3 AND m>=4 THEN 'Cannot Lose Them' WHEN r>=3 AND f<3 AND m<3 THEN 'New Customers' WHEN r<3 AND f<3 AND m<3 THEN 'Lost Customers' ELSE 'Regular Customers' END nam,
  CASE WHEN ch>0.5 THEN 'retention_focused' WHEN m>=4 THEN 'premium_experience' WHEN f>=4 THEN 'loyalty_rewards' WHEN r>=4 THEN 'cross_sell_upsell' ELSE 'reactivation_campaign' END st FROM ng)"""


def _coded(t):
    code = F.col("recency_score") * 100 + F.col("frequency_score") * 10 + F.col("monetary_score")
    return cus.name_segments(scored(t).withColumn("code", code), "code")


@query(
    "customer_segment_names",
    "CUS-2",
    f"""{_SEG}
SELECT code, n AS customers, {q('r')} AS r, {q('f')} AS f, {q('m')} AS m, {q('ch')} AS churn_share, {q('lv')} AS lifetime_value, nam AS name, st AS strategy FROM nm""",
)
def customer_segment_names(t):
    return _coded(t)


@query(
    "customer_overview",
    "CMB-10",
    f"""{_SEG}
SELECT count(*) AS segments, sum(n)::BIGINT AS customers, {q('sum(ch*n)/sum(n)')} AS weighted_churn, {q('sum(lv)')} AS lifetime_value FROM nm""",
)
def customer_overview(t):
    return cus.segment_overview(_coded(t))


@query(
    "customer_lifecycle",
    "CUS-7",
    f"""
, a AS (SELECT user_id, max(ts)::DATE d, sum(CAST(value AS DECIMAL(12,2))) v, count(*) n FROM events GROUP BY 1 HAVING count(*)>=3),
b AS (SELECT ((SELECT max(ts)::DATE FROM events)-d)::INT dd, v, n FROM a)
SELECT count(*) AS total_customers, count(*) FILTER (WHERE dd<=7) AS active, count(*) FILTER (WHERE dd BETWEEN 8 AND 30) AS at_risk, count(*) FILTER (WHERE dd>30) AS churned,
  {q('sum(v)::DOUBLE/count(*)')} AS avg_value, {q('avg(n)')} AS avg_frequency, {q('(count(*) FILTER (WHERE dd>30))::DOUBLE/count(*)')} AS churn_rate, {q('(count(*) FILTER (WHERE dd<=30))::DOUBLE/count(*)')} AS retention_rate FROM b""",
)
def customer_lifecycle(t):
    ev = t.raw("events")
    last = ev.agg(F.max("ts").cast("date")).first()[0]
    act = ev.select(
        F.col("user_id").alias("customer_id"), F.col("ts").cast("date").alias("day"), F.col("value").cast("decimal(12,2)").alias("value")
    )
    return cus.lifecycle(act, last)


@query(
    "customer_seasonality",
    "CUS-3",
    f"""
, m AS (SELECT first_category, month(sale_date) mm, {MEAN('units_sold')} a, sum(units_sold)*25.0::DOUBLE r FROM sales GROUP BY 1,2 HAVING count(*)>=10),
g AS (SELECT first_category, avg(a) o, stddev_samp(a) s, max(a)/min(a) pl, sum(r) ar FROM m GROUP BY 1)
SELECT first_category, {q('s/o')} AS variation, {q('pl')} AS peak_to_low, {q('ar')} AS annual_revenue FROM g WHERE s>o*0.01""",
)
def customer_seasonality(t):
    return cus.seasonal_patterns(t.sales(geo=False), min_cv=0.01)


@query(
    "customer_promotion_response",
    "CUS-4",
    f"""
, g AS (SELECT first_category, {MEAN('units_sold', 'discount>0')} p, {MEAN('units_sold', 'discount=0')} r, (sum(units_sold) FILTER (WHERE discount>0))*25.0::DOUBLE pr, sum(units_sold)*25.0::DOUBLE cr FROM sales GROUP BY 1
  HAVING count(*) FILTER (WHERE discount>0)>=10 AND count(*) FILTER (WHERE discount=0)>=10)
SELECT first_category, {q('p')} AS promo_avg, {q('r')} AS regular_avg, {q('pr')} AS promo_revenue, {q('cr')} AS category_revenue, {q('p/r')} AS lift FROM g WHERE p/r>0.5""",
)
def customer_promotion_response(t):
    return cus.promotion_response(t.sales(geo=False), min_lift=0.5)


@query(
    "customer_weekday_profile",
    "CUS-5 WIN-2",
    f"""
, g AS (SELECT (isodow(sale_date)-1)::INT w, {MEAN('units_sold')} a, count(*) n, sum(units_sold)::BIGINT u FROM lines GROUP BY 1)
SELECT w AS day_of_week, {q('a')} AS avg_sales, n AS transactions, u AS total_units, {q('a/avg(a) OVER ()')} AS relative_performance FROM g""",
)
def customer_weekday_profile(t):
    return cus.weekday_profile(t.lines())


@query(
    "customer_preferences",
    "CUS-8",
    f"""
, g AS (SELECT product_id, sum(units_sold)::BIGINT u, sum(units_sold)*25.0::DOUBLE r, {MEAN('units_sold')} a FROM lines GROUP BY 1 HAVING count(*)>=10)
SELECT first_category, count(*) AS products, {q('sum(r)')} AS revenue, {q('avg(a)')} AS avg_sales, sum(u)::BIGINT AS total_units FROM g JOIN product USING (product_id) GROUP BY 1""",
)
def customer_preferences(t):
    return cus.preferences(t.lines(), t.product)


# ---- competition -------------------------------------------------------------------------------


@query(
    "competition_profile",
    "CMP-1 WIN-1",
    f"""
, g AS (SELECT first_category, {MEAN('units_sold')} a, stddev_samp(units_sold::DOUBLE) s, count(DISTINCT store_id) sc, count(DISTINCT product_id) pv, sum(units_sold)*25.0::DOUBLE r FROM sales
  WHERE sale_date>=(SELECT d FROM ref)-90 GROUP BY 1 HAVING count(*)>=30)
SELECT first_category, {q('a')} AS avg_sales, {q('s')} AS sales_std, sc AS store_coverage, pv AS product_variety, {q('r')} AS estimated_revenue, (rank() OVER (ORDER BY r DESC))::INT AS revenue_rank FROM g""",
)
def competition_profile(t):
    return cmp.category_profile(t.sales(geo=False, since=t.day(90)))


_THR = f"""
, g AS (SELECT first_category, {MEAN('units_sold', 'sale_date>=(SELECT d FROM ref)-14')} n, {MEAN('units_sold', 'sale_date<=(SELECT d FROM ref)-14')} o, sum(units_sold)*25.0::DOUBLE r FROM sales
  WHERE sale_date>=(SELECT d FROM ref)-45 GROUP BY 1 HAVING count(*)>=20),
th AS (SELECT *, (n-o)/o ch FROM g WHERE o>0),
tv AS (SELECT *, CASE WHEN abs(ch)>0.25 THEN 'critical' WHEN abs(ch)>0.15 THEN 'high' ELSE 'medium' END sev FROM th WHERE ch < -0.02)"""


def _threats(t):
    return cmp.threats(t.sales(geo=False, since=t.day(45)), t.as_of, decline=0.02)


@query(
    "competition_threats",
    "CMP-2",
    f"""{_THR}
SELECT first_category, {q('n')} AS recent_avg, {q('o')} AS baseline_avg, {q('r')} AS revenue, {q('ch')} AS change, sev AS severity, {q('r*abs(ch)')} AS impact,
  CASE sev WHEN 'critical' THEN 5 WHEN 'high' THEN 4 ELSE 3 END AS urgency FROM tv""",
)
def competition_threats(t):
    return _threats(t)


_OPP = f"""
, og AS (SELECT second_category, count(DISTINCT product_id) pc, sum(units_sold)*25.0::DOUBLE tr, {MEAN('units_sold')} ap FROM sales GROUP BY 1 HAVING count(*)>=20),
ox AS (SELECT *, tr/sum(tr) OVER () ms, rank() OVER (ORDER BY ap) pr, rank() OVER (ORDER BY tr DESC) rr FROM og),
ob AS (SELECT *, least(0.85, 0.4+pc/20) sp, CASE WHEN pc>=15 THEN 'low' WHEN pc>=10 THEN 'medium' ELSE 'high' END df, CASE WHEN ms<0.05 THEN 'high' WHEN ms<0.1 THEN 'medium' ELSE 'low' END im
  FROM ox WHERE ms<0.15 AND pc>=5)"""


def _opportunities(t):
    return cmp.opportunities(t.sales(geo=False), category="second_category")


@query(
    "competition_opportunities",
    "CMP-3 SRT-1",
    f"""{_OPP}
SELECT second_category, pc AS product_count, {q('tr')} AS total_revenue, {q('ap')} AS avg_performance, {q('ms')} AS market_share, pr::INT AS performance_rank, rr::INT AS revenue_rank, {q('tr*1.5')} AS revenue_potential,
  {q('sp')} AS success_probability, df AS difficulty, im AS importance FROM ob""",
)
def competition_opportunities(t):
    return _opportunities(t)


@query(
    "competition_pricing",
    "CMP-4",
    f"""
, g AS (SELECT first_category, count(*) n, {MEAN('units_sold')}*25 av, stddev_samp(units_sold*25.0::DOUBLE) sd, min(units_sold)*25.0::DOUBLE mn, max(units_sold)*25.0::DOUBLE mx, sum(units_sold)::BIGINT tv FROM sales
  WHERE units_sold>0 AND sale_date>=(SELECT d FROM ref)-30 GROUP BY 1 HAVING count(*)>=20)
SELECT first_category, n AS sample_size, {q('av')} AS avg_value, {q('sd')} AS value_std, {q('mn')} AS min_value, {q('mx')} AS max_value, tv AS total_volume,
  CASE WHEN av>75 THEN 'premium' WHEN av>40 THEN 'mid_market' WHEN av>20 THEN 'value' ELSE 'budget' END AS pricing_tier, {q('tv::DOUBLE/(sum(tv) OVER ())::DOUBLE')} AS volume_share,
  CASE WHEN sd>av*0.3 THEN 'high' ELSE 'moderate' END AS pricing_pressure FROM g""",
)
def competition_pricing(t):
    return cmp.pricing(t.sales(geo=False, since=t.day(30)))


@query(
    "competition_market_size",
    "CMP-5",
    f"""
, g AS (SELECT first_category, sum(units_sold)::BIGINT u, sum(units_sold)*25.0::DOUBLE r, count(DISTINCT store_id) s, count(DISTINCT product_id) p FROM sales WHERE sale_date>=(SELECT d FROM ref)-90 GROUP BY 1)
SELECT first_category, u AS units, {q('r')} AS revenue, s AS stores, p AS products, {q('r/sum(r) OVER ()')} AS category_share, {q('r*3.5')} AS estimated_market,
  CASE WHEN r/sum(r) OVER ()>0.15 THEN 'challenger' ELSE 'follower' END AS position FROM g""",
)
def competition_market_size(t):
    return cmp.market_size(t.sales(geo=False, since=t.day(90)))


@query(
    "competitive_strength",
    "CMP-6",
    f"""{_THR}{_OPP}
, pn AS (SELECT coalesce(sum(CASE sev WHEN 'critical' THEN 10 WHEN 'high' THEN 5 ELSE 0 END),0)::BIGINT p FROM tv), bn AS (SELECT (count(*) FILTER (WHERE tr*1.5>40000)*5+count(*) FILTER (WHERE im='high')*3)::BIGINT b FROM ob)
SELECT p AS penalty, b AS bonus, {q('greatest(20,least(95,70-p+b))')} AS strength FROM pn, bn""",
)
def competitive_strength(t):
    return cmp.strength(_threats(t), _opportunities(t))
