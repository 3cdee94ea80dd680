"""Promotion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as cor
from ..operators import promotions as prm
from ..operators import weather as wea
from ..operators.holidays import holiday_boost
from .features import MEAN
from .registry import q, query


@query(
    "uplift_by_level",
    "PRM-1 AGG-17 FN-13",
    f"""
, s AS (SELECT product_id, store_id, sale_amount v, discount>0 p, CASE WHEN discount*100<=0 THEN 'none' WHEN discount*100<10 THEN 'light' WHEN discount*100<20 THEN 'moderate' WHEN discount*100<30 THEN 'deep' WHEN discount*100<50 THEN 'very_deep' ELSE 'extreme' END b FROM lines),
bs AS (SELECT product_id, count(*) n, {MEAN('v', 'NOT p')} bl, {MEAN('v', 'p')} pr FROM s GROUP BY 1 HAVING count(*)>=30),
b2 AS (SELECT * FROM bs WHERE bl IS NOT NULL AND pr IS NOT NULL),
u AS (SELECT product_id, 'overall' lv, 'all' mb, bl, pr, n FROM b2
  UNION ALL SELECT s.product_id, 'depth', b, any_value(bl), {MEAN('v')}, count(*) FROM s JOIN b2 USING (product_id) WHERE p GROUP BY 1,3
  UNION ALL SELECT * FROM (SELECT s.product_id, 'store', store_id::VARCHAR, {MEAN('v', 'NOT p')} x, {MEAN('v', 'p')} y, count(*) FROM s WHERE product_id IN (SELECT product_id FROM b2) GROUP BY 1,3) WHERE x>0 AND y IS NOT NULL)
SELECT product_id, lv AS level, mb AS member, {q('bl')} AS baseline, {q('pr')} AS promoted, n AS sample, {q('(pr-bl)/bl*100')} AS uplift_pct FROM u""",
)
def uplift_by_level(t):
    return prm.uplift_by_level(t.lines())


def _cross(keys):
    k = "".join(f"{c}, " for c in keys)
    on = lambda a, b: "".join(f" AND {a}.{c}={b}.{c}" for c in keys)
    return f"""
, d AS (SELECT {k}first_category i, sale_date, sum(sale_amount) v, bool_or(activity_flag) p FROM sales GROUP BY ALL),
sn AS (SELECT {k}i, count(*) n, count(*) FILTER (WHERE p) np FROM d GROUP BY ALL HAVING count(*)>=10),
x AS (SELECT {''.join(f'b.{c}, ' for c in keys)}a.i ia, b.i ib, v, coalesce((SELECT bool_or(p) FROM d dd WHERE dd.i=a.i AND dd.sale_date=b.sale_date{on('dd', 'b')}), FALSE) o
  FROM sn a JOIN d b ON a.i<>b.i{on('a', 'b')} JOIN sn c ON c.i=b.i{on('c', 'b')} WHERE a.np>0),
g AS (SELECT {k}ia, ib, {MEAN('v', 'o')} du, {MEAN('v', 'NOT o')} nm FROM x GROUP BY ALL),
z AS (SELECT *, (du-nm)/nm*100 im FROM g WHERE nm>0 AND du IS NOT NULL)
SELECT {k}ia AS item_a, ib AS item_b, {q('du')} AS during, {q('nm')} AS normal, {q('im')} AS impact_pct, CASE WHEN im>0 THEN 'positive' ELSE 'negative' END AS impact_type,
  CASE WHEN abs(im)>15 THEN 'high' WHEN abs(im)>5 THEN 'moderate' ELSE 'low' END AS significance, CASE WHEN im < -20 THEN 'high' WHEN im < -10 THEN 'moderate' ELSE 'low' END AS cannibalisation FROM z"""


def _pairs(t):
    return prm.both_ways(cor.category_correlations(t.sales(geo=False)))


@query("promotion_cross_effects", "PRM-2 PRM-14", _cross([]).replace("bool_or(activity_flag) p", "count(*) FILTER (WHERE activity_flag)*2>count(*) p"))
def promotion_cross_effects(t):
    # a category-day counts as promoted when most of its sales are
    d = (
        t.sales(geo=False)
        .groupBy("first_category", "sale_date")
        .agg(F.sum("sale_amount").alias("sale_amount"), (F.count_if("activity_flag") * 2 > F.count(F.lit(1))).alias("activity_flag"))
    )
    return prm.cross_effects(d, _pairs(t), "first_category")


@query("promotion_cannibalisation", "PRM-3 JN-6", _cross(["store_id"]))
def promotion_cannibalisation(t):
    d = t.daily("store_id", "first_category", geo=False)
    return prm.cross_effects(d, _pairs(t), "first_category", ["store_id"])


@query(
    "promotion_effectiveness",
    "PRM-4 AGG-10",
    f"""
, g AS (SELECT store_id, count(*) n, greatest(max(sale_date)-min(sale_date),1) sp, count(*) FILTER (WHERE activity_flag) nf, {MEAN('sale_amount', 'activity_flag')} pf, {MEAN('sale_amount', 'NOT activity_flag')} rf FROM sales GROUP BY 1),
b AS (SELECT store_id, arg_max(discount, m) bd FROM (SELECT store_id, discount, {MEAN('sale_amount')} m FROM sales WHERE activity_flag GROUP BY 1,2) GROUP BY 1)
SELECT store_id, {q('(pf-rf)/rf*100')} AS average_uplift, {q('nf::DOUBLE/sp*100')} AS promotion_frequency, {q('bd')} AS best_discount, nf AS total_promotions FROM g JOIN b USING (store_id)""",
)
def promotion_effectiveness(t):
    return prm.effectiveness(t.sales(geo=False, category=False), ["store_id"])


@query(
    "promotion_recommendations",
    "PRM-5 CMB-5",
    f"""
, b AS (SELECT store_id, coalesce({MEAN('sale_amount', 'discount=0')},{MEAN('sale_amount')}) bs FROM lines GROUP BY 1),
p AS (SELECT store_id, (discount*100)::DOUBLE dp, count(*) n, {MEAN('sale_amount')} a FROM lines WHERE discount*100 BETWEEN 5 AND 60 GROUP BY 1,2),
x AS (SELECT p.*, (a-bs)/bs*100 u FROM p JOIN b USING (store_id) WHERE n>=2)
SELECT store_id, {q('dp')} AS discount_pct, n AS "rows", {q('greatest(0,u)')} AS estimated_uplift, CASE WHEN n>21 THEN 'long' WHEN n>14 THEN 'medium' ELSE 'short' END AS duration,
  {q('(u/100-dp/100)/(dp/100)')} AS estimated_roi, CASE WHEN u<0 THEN 'conservative' WHEN u<10 THEN 'balanced' ELSE 'data_driven' END AS strategy FROM x""",
)
def promotion_recommendations(t):
    return prm.recommend_discounts(t.lines(), ["store_id"])


@query(
    "group_uplift",
    "PRM-6",
    f"""
, g AS (SELECT store_id, first_category, {MEAN('sale_amount', 'activity_flag')} p, {MEAN('sale_amount', 'NOT activity_flag')} r FROM sales GROUP BY 1,2)
SELECT store_id, first_category, {q('p')} AS promo_sales, {q('r')} AS regular_sales, {q('p-r')} AS uplift, {q('(p-r)/r*100')} AS uplift_pct FROM g WHERE p IS NOT NULL AND r IS NOT NULL""",
)
def group_uplift(t):
    return prm.group_uplift(t.sales(geo=False), ["store_id", "first_category"])


@query(
    "uplift_effectiveness",
    "PRM-7 WIN-12 CMB-12",
    f"""
, b AS (SELECT store_id, first_category, {MEAN('sale_amount')} m FROM sales WHERE NOT activity_flag GROUP BY 1,2),
r AS (SELECT store_id, first_category, (sale_amount::DOUBLE-m)/m u FROM sales JOIN b USING (store_id, first_category) WHERE activity_flag),
g AS (SELECT store_id, first_category, avg(u) mu, stddev_samp(u) sd, count(*) n, median(u) md FROM r GROUP BY 1,2)
SELECT store_id, first_category, {q('mu')} AS uplift_mean, {q('sd')} AS uplift_std, n AS uplift_count, {q('md')} AS uplift_median, {q('(rank() OVER (ORDER BY mu))/(count(*) OVER ())::DOUBLE*100')} AS uplift_percentile FROM g""",
)
def uplift_effectiveness(t):
    keys = ["store_id", "first_category"]
    return prm.effectiveness_table(prm.row_uplift(t.sales(geo=False), keys), keys)


_KEYS = ["store_id", "first_category"]
_DI = f"""
, ic AS (SELECT store_id, first_category, CASE WHEN discount<=0 THEN 0 WHEN discount<=0.1 THEN 1 WHEN discount<=0.2 THEN 2 WHEN discount<=0.3 THEN 3 ELSE 4 END c, count(*) n, {MEAN('sale_amount')} m FROM sales GROUP BY 1,2,3),
ig AS (SELECT store_id, first_category, count(*) FILTER (WHERE n>=3) k, max(m) FILTER (WHERE n>=3 AND c=0) b, max(m) FILTER (WHERE n>=3 AND c=1) t FROM ic GROUP BY 1,2),
im AS (SELECT store_id, first_category, CASE WHEN k=0 THEN 0.15::DOUBLE ELSE greatest(0.05::DOUBLE, coalesce(t, coalesce(b,1))/coalesce(b,1)-1) END inc, CASE WHEN k=0 THEN 100::DOUBLE ELSE coalesce(b,1)*30 END rev FROM ig)"""


@query("discount_impact", "PRM-9 FN-13", f"{_DI}\nSELECT store_id, first_category, {q('inc')} AS expected_increase, {q('rev')} AS base_revenue FROM im")
def discount_impact(t):
    return prm.discount_impact(t.sales(geo=False), _KEYS, 0.10)


_EFF = f"""
, ef AS (SELECT store_id, first_category, CASE WHEN avg_temperature<18 THEN 'cold' WHEN avg_temperature>25 THEN 'warm' ELSE 'mild' END tc, CASE WHEN precpt>5 THEN 'rainy' WHEN precpt<1 THEN 'dry' ELSE 'normal' END rc,
   count(*) n, {MEAN('sale_amount')} a FROM sales GROUP BY 1,2,3,4 HAVING count(*)>=3),
ew AS (SELECT *, row_number() OVER (PARTITION BY store_id, first_category ORDER BY a DESC, tc, rc) bp, row_number() OVER (PARTITION BY store_id, first_category ORDER BY a, tc, rc) wp,
   avg(a) OVER (PARTITION BY store_id, first_category) mc, stddev_samp(a) OVER (PARTITION BY store_id, first_category) sdv FROM ef),
ct AS (SELECT st.store_id, CASE WHEN w.avg_temperature<18 THEN 'cold' WHEN w.avg_temperature>25 THEN 'warm' ELSE 'mild' END tc, CASE WHEN w.precpt>5 THEN 'rainy' WHEN w.precpt<1 THEN 'dry' ELSE 'normal' END rc
  FROM store st JOIN weather w ON w.city_id=st.city_id WHERE w.date=(SELECT max(date) FROM weather w2 WHERE w2.city_id=st.city_id)),
ad AS (SELECT ew.store_id, first_category, ew.tc, ew.rc, (a/mc-1)*100 pc, bp<=2 bb, wp<=2 ww, sdv/mc se FROM ew JOIN ct ON ct.store_id=ew.store_id AND ct.tc=ew.tc AND ct.rc=ew.rc),
av AS (SELECT *, CASE WHEN bb THEN least(50,pc) WHEN ww THEN greatest(-30,pc) ELSE 0 END im FROM ad),
ax AS (SELECT *, CASE WHEN bb THEN 1+im/100 WHEN ww THEN 1-abs(im)/100 ELSE 1 END wb FROM av)"""


def current_conditions(t):
    """Temperature and rain class of each store's city on its last weather day."""
    w = t.weather.groupBy("city_id").agg(
        F.max_by("avg_temperature", "date").alias("t"), F.max_by("precpt", "date").alias("p")
    )
    temp = F.when(F.col("t") < 18, "cold").when(F.col("t") > 25, "warm").otherwise("mild")
    rain = F.when(F.col("p") > 5, "rainy").when(F.col("p") < 1, "dry").otherwise("normal")
    return t.store.select("store_id", "city_id").join(w, "city_id").select("store_id", temp.alias("temp_class"), rain.alias("rain_class"))


def _advice(t):
    s = t.sales()
    now = current_conditions(t).join(s.select("store_id", "first_category").distinct(), "store_id")
    return wea.weather_advice(wea.condition_effects(s, _KEYS), now, _KEYS)


@query(
    "weather_stock_advice",
    "WEA-11 WEA-10 CMB-5",
    f"""{_EFF}
SELECT store_id, first_category, tc AS temp_class, rc AS rain_class, CASE WHEN bb THEN 'increase_stock' WHEN ww THEN 'decrease_stock' ELSE 'normal' END AS recommendation, {q('im')} AS impact_pct,
  {q('CASE WHEN bb THEN least(0.9, 0.5+coalesce(se,0)) ELSE 0.5 END')} AS confidence, {q('wb')} AS weather_boost,
  (CASE WHEN bb THEN greatest(10, trunc(im*2)) WHEN ww THEN greatest(-20, trunc(im*2)) ELSE 0 END)::INT AS stock_adjustment FROM ax""",
)
def weather_stock_advice(t):
    return _advice(t)


@query(
    "promotion_impact",
    "PRM-10 HOL-4",
    f"""{_DI}{_EFF}
, hg AS (SELECT store_id, first_category, count(*) FILTER (WHERE holiday_flag) nh, count(*) FILTER (WHERE NOT holiday_flag) nr, {MEAN('sale_amount', 'holiday_flag')} h, {MEAN('sale_amount', 'NOT holiday_flag')} r FROM sales GROUP BY 1,2),
hb AS (SELECT store_id, first_category, CASE WHEN nh<3 AND nr<3 THEN 1::DOUBLE ELSE greatest(0.8::DOUBLE, least(1.5::DOUBLE, (CASE WHEN nh>=3 THEN h ELSE 1 END)/(CASE WHEN nr>=3 THEN r ELSE 1 END))) END b FROM hg),
j AS (SELECT im.*, coalesce(wb,1) w, coalesce(hb.b,1) h, inc*(coalesce(wb,1)*coalesce(hb.b,1)) si FROM im LEFT JOIN ax USING (store_id, first_category) LEFT JOIN hb USING (store_id, first_category)),
k AS (SELECT *, rev*(1+si)*(1-0.1::DOUBLE)-rev ri FROM j)
SELECT store_id, first_category, {q('inc')} AS expected_increase, {q('rev')} AS base_revenue, {q('w')} AS weather_boost, {q('h')} AS holiday_boost, {q('si')} AS sales_increase, {q('ri')} AS revenue_impact,
  CASE WHEN ri>25 AND si>0.2 THEN 'HIGHLY RECOMMENDED' WHEN ri>0 AND si>0.1 THEN 'RECOMMENDED' WHEN ri>-10 AND si>0.08 THEN 'MODERATE' ELSE 'NOT RECOMMENDED' END AS recommendation,
  CASE WHEN w>1.15 AND h>1.1 THEN 'OPTIMAL' WHEN w>1.15 OR h>1.1 THEN 'GOOD' WHEN w<0.9 OR h<0.9 THEN 'POOR' ELSE 'NEUTRAL' END AS timing FROM k""",
)
def promotion_impact(t):
    boost = _advice(t).select(*_KEYS, "weather_boost")
    hol = holiday_boost(t.sales(geo=False), _KEYS)
    return prm.promotion_impact(prm.discount_impact(t.sales(geo=False), _KEYS, 0.10), boost, hol, _KEYS, 0.10)


@query(
    "promotion_days_effect",
    "PRM-11 JN-8",
    f"""
, c AS (SELECT l.sale_date, l.store_id, l.product_id, p.promotion_type, p.discount_percentage, row_number() OVER (PARTITION BY l.sale_date, l.store_id, l.product_id ORDER BY p.start_date DESC, p.promotion_id DESC) AS rn
  FROM lines l JOIN promotions p ON l.sale_date BETWEEN p.start_date AND p.end_date AND (p.store_id IS NULL OR p.store_id=l.store_id) AND (p.product_id IS NULL OR p.product_id=l.product_id))
SELECT promotion_type, discount_percentage::INT AS promotion_discount, count(*) AS "rows", {q(MEAN('sale_amount'))} AS mean_amount, sum(units_sold)::BIGINT AS units
FROM c JOIN lines l ON c.sale_date=l.sale_date AND c.store_id=l.store_id AND c.product_id=l.product_id WHERE rn=1 AND discount_percentage>=10 GROUP BY 1,2""",
)
def promotion_days_effect(t):
    return prm.promotion_days_effect(t.lines(), t.promotions, low=10)


@query(
    "price_elasticity",
    "PRM-14",
    f"""
SELECT product_id, count(*) AS "rows", {q('regr_slope(ln(units_sold::DOUBLE), ln(sale_amount::DOUBLE/units_sold))')} AS elasticity FROM lines WHERE units_sold>0 AND sale_amount>0 GROUP BY 1 HAVING count(*)>=10""",
)
def price_elasticity(t):
    return prm.price_elasticity(t.lines(), ["product_id"])


_SEG = {
    "hot": "avg_temperature>=25", "mild": "avg_temperature BETWEEN 15 AND 25", "cold": "avg_temperature<=15", "rainy": "precpt>=2", "dry": "precpt<=1",
    "humid": "avg_humidity>=75", "low_humidity": "avg_humidity<=50",
}
_SEGS = ", w AS (" + " UNION ALL ".join(f"SELECT '{n}' segment, sale_amount v, discount, discount>0 p FROM sales WHERE {c}" for n, c in _SEG.items()) + ")"
_MAT = f"""{_SEGS}
, g AS (SELECT segment, count(*) FILTER (WHERE p) np, count(*) FILTER (WHERE NOT p) nb, {MEAN('v', 'p')} pm, {MEAN('v', 'NOT p')} bm FROM w GROUP BY 1),
m AS (SELECT *, (pm-bm)/bm*100 u FROM g WHERE np>=6 AND nb>=6)"""


def _matrix(t):
    return prm.weather_promotion_matrix(t.sales(category=False))


@query(
    "weather_promotion_matrix",
    "PRM-13",
    f"""{_MAT}
SELECT segment, np AS promo_rows, nb AS base_rows, {q('pm')} AS promo_mean, {q('bm')} AS base_mean, {q('u')} AS uplift_pct,
  CASE WHEN u>20 AND np>20 THEN 'High Priority' WHEN u>10 AND np>10 THEN 'Medium Priority' WHEN u>5 THEN 'Low Priority' ELSE 'Not Recommended' END AS priority,
  CASE WHEN u>15 THEN 'aggressive' WHEN u>8 THEN 'moderate' WHEN u>3 THEN 'light' ELSE 'operational' END AS strategy, u>10 AS trigger FROM m""",
)
def weather_promotion_matrix(t):
    return _matrix(t)


@query(
    "weather_discount_effect",
    "PRM-13",
    f"""{_SEGS}
, r AS (SELECT segment, CASE WHEN discount*100<=10 THEN 'up to 10%' WHEN discount*100<=20 THEN '10-20%' WHEN discount*100<=30 THEN '20-30%' ELSE 'over 30%' END dr, count(*) n, {MEAN('v')} m, {MEAN('discount')} d FROM w WHERE p GROUP BY 1,2)
SELECT segment, dr AS discount_range, n AS "rows", {q('m')} AS mean_sales, {q('m/(d*100)')} AS sales_per_point FROM r WHERE n>=4""",
)
def weather_discount_effect(t):
    return prm.weather_discount_effect(t.sales(category=False))


@query(
    "weather_promotion_calendar",
    "PRM-13",
    f"""{_MAT}
, c AS (SELECT month(sale_date)::INT mo, count(*) n, avg(avg_temperature) tm, avg(precpt) pr FROM sales GROUP BY 1),
s AS (SELECT *, CASE WHEN tm<15 THEN 'cold' WHEN tm>25 THEN 'hot' ELSE 'mild' END sg FROM c WHERE n>=6)
SELECT sg AS segment, mo AS month, n AS "rows", {q('tm')} AS mean_temp, {q('pr')} AS mean_rain, CASE WHEN pr>2 THEN sg || '_rainy' ELSE sg END AS weather, {q('u')} AS uplift_pct FROM s LEFT JOIN m ON m.segment=sg""",
)
def weather_promotion_calendar(t):
    return prm.weather_calendar(t.sales(category=False), _matrix(t))


@query(
    "weather_promotion_roi",
    "PRM-13",
    f"""{_MAT}
SELECT segment, {q('pm-bm')} AS extra_sales, {q('pm*0.15')} AS discount_cost, {q('((pm-bm)-pm*0.15)/(pm*0.15)*100')} AS roi_pct FROM m""",
)
def weather_promotion_roi(t):
    return prm.weather_roi(_matrix(t))
