"""Holiday queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import holidays as hol
from .features import MEAN
from .registry import q, query


@query(
    "holiday_lift",
    "HOL-1 AGG-17",
    f"""
, g AS (SELECT product_id, {MEAN('sale_amount', 'holiday_flag')} h, {MEAN('sale_amount', 'NOT holiday_flag')} r, count(*) FILTER (WHERE holiday_flag) n FROM sales GROUP BY 1)
SELECT product_id, {q('h')} AS avg_holiday_sales, {q('r')} AS avg_regular_sales, n AS holiday_count, {q('h-r')} AS absolute_lift, {q('(h-r)/r*100')} AS percentage_lift
FROM g WHERE h IS NOT NULL AND r IS NOT NULL""",
)
def holiday_lift(t):
    return hol.holiday_lift(t.sales(geo=False, category=False), ["product_id"])


@query(
    "holiday_lift_by_day",
    "HOL-2",
    f"""
, d AS (SELECT sale_date, sum(sale_amount) a FROM lines GROUP BY 1),
b AS (SELECT h.date, any_value(holiday_name) nm, sum(a)::DOUBLE/count(*) m FROM holidays h JOIN d ON d.sale_date BETWEEN h.date-28 AND h.date+28 AND d.sale_date<>h.date AND isodow(d.sale_date)=isodow(h.date) GROUP BY 1)
SELECT b.date::VARCHAR AS date, nm AS holiday_name, {q('a')} AS holiday_sales, {q('m')} AS normal_sales, {q('a::DOUBLE-m')} AS sales_lift, {q('(a::DOUBLE-m)/m*100')} AS sales_lift_pct
FROM b JOIN d ON d.sale_date=b.date""",
)
def holiday_lift_by_day(t):
    return hol.holiday_lift_by_day(t.lines(), t.holidays)


_BOOST = f"""
, g AS (SELECT store_id, product_id%20 AS grp, count(*) FILTER (WHERE holiday_flag) nh, count(*) FILTER (WHERE NOT holiday_flag) nr,
  {MEAN('sale_amount', 'holiday_flag')} h, {MEAN('sale_amount', 'NOT holiday_flag')} r FROM sales GROUP BY 1,2),
x AS (SELECT store_id, grp, CASE WHEN nh<3 AND nr<3 THEN 1::DOUBLE ELSE greatest(0.8::DOUBLE, least(1.5::DOUBLE,
   (CASE WHEN nh>=3 THEN h ELSE 1 END)/(CASE WHEN nr>=3 THEN r ELSE 1 END))) END b FROM g)"""


def _boost(t):
    s = t.sales(geo=False, category=False).withColumn("grp", F.col("product_id") % 20)
    return hol.holiday_boost(s, ["store_id", "grp"])


@query("holiday_boost", "HOL-4", f"{_BOOST}\nSELECT store_id, grp, {q('b')} AS holiday_boost, b>1.15 AS sensitive FROM x")
def holiday_boost(t):
    return _boost(t)


@query(
    "holiday_status",
    "HOL-4",
    f"""{_BOOST}
, s AS (SELECT coalesce(avg(b) FILTER (WHERE b<>1),1) m, count(*) FILTER (WHERE b>1.15) n FROM x)
SELECT {q('m')} AS mean_boost, n AS sensitive_keys, CASE WHEN m>1.1 THEN 'holiday_period' WHEN m>1.05 THEN 'pre_holiday' ELSE 'normal' END AS status FROM s""",
)
def holiday_status(t):
    return hol.holiday_status(_boost(t))
