"""Scans, filters and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import scans
from .registry import q, query

_SALES_COLS = """sale_date::VARCHAR AS sale_date, s.store_id, store_name, s.city_id, c.city_name, s.product_id, product_name,
  s.first_category, units_sold, {amount} AS sale_amount, {disc} AS discount, holiday_flag, activity_flag""".format(
    amount=q("sale_amount"), disc=q("discount")
)


@query(
    "scan_sales",
    "SRC-1 JN-1 FLT-1 FLT-2 SRT-1",
    f"""
SELECT {_SALES_COLS}, stock_hour6_22_cnt
FROM sales s JOIN store st USING (store_id) JOIN product p USING (product_id) JOIN city c ON c.city_id = s.city_id""",
)
def scan_sales(t):
    return scans.scan_sales(t)


@query(
    "scan_sales_filtered",
    "SRC-1 FLT-1 FLT-2 FLT-3",
    f"""
SELECT {_SALES_COLS}
FROM sales s JOIN store st USING (store_id) JOIN product p USING (product_id) JOIN city c ON c.city_id = s.city_id
WHERE s.city_id IN (1,2,3) AND sale_date BETWEEN (SELECT d FROM ref)-365 AND (SELECT d FROM ref)-5""",
)
def scan_sales_filtered(t):
    return scans.scan_sales(t, city_ids=[1, 2, 3], start=t.day(365), end=t.day(5), stockouts=False)


@query(
    "scan_history",
    "SRC-2 FLT-3",
    f"""
SELECT sale_date::VARCHAR AS ds, {q('sale_amount')} AS y, store_id, product_id, units_sold AS sale_qty,
  activity_flag AS promo_flag, holiday_flag, stock_hour6_22_cnt AS stockout_hours
FROM sales WHERE first_category='ECONOMY'""",
)
def scan_history(t):
    return scans.scan_history(t, category="ECONOMY")


@query(
    "scan_category_sales",
    "SRC-3 JN-2",
    f"""
SELECT sale_date::VARCHAR AS sale_date, l.store_id, store_name, s.city_id, l.product_id, first_category, second_category,
  units_sold, {q('sale_amount')} AS sale_amount, {q('avg_temperature')} AS avg_temperature, {q('precpt')} AS precpt
FROM lines l JOIN store s ON l.store_id=s.store_id JOIN product p ON l.product_id=p.product_id
LEFT JOIN weather w ON w.date=l.sale_date AND w.city_id=s.city_id""",
)
def scan_category_sales(t):
    return scans.scan_category_sales(t)


@query(
    "sales_page",
    "SRC-10 FLT-8",
    f"""
SELECT sale_date::VARCHAR AS sale_date, l.store_id, store_name, s.city_id, l.product_id, first_category, second_category,
  units_sold, {q('sale_amount')} AS sale_amount, {q('avg_temperature')} AS avg_temperature, {q('precpt')} AS precpt
FROM lines l JOIN store s ON l.store_id=s.store_id JOIN product p ON l.product_id=p.product_id
LEFT JOIN weather w ON w.date=l.sale_date AND w.city_id=s.city_id
ORDER BY l.sale_date, l.store_id, l.product_id LIMIT 50 OFFSET 100""",
)
def sales_page(t):
    return scans.scan_category_sales(t, limit=50, offset=100)


@query(
    "scan_weather",
    "SRC-4",
    f"""
SELECT city_id, date::VARCHAR AS date, {q('avg_temperature')} AS avg_temperature, {q('avg_humidity')} AS avg_humidity,
  {q('precpt')} AS precpt, {q('avg_wind_level')} AS avg_wind_level FROM weather""",
)
def scan_weather(t):
    return scans.scan_weather(t)


_PROMO = """promotion_id, p.store_id, p.product_id, start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date,
  promotion_type, discount_percentage"""


@query(
    "scan_promotions",
    "SRC-5",
    f"""
SELECT {_PROMO} FROM promotions p
WHERE end_date >= (SELECT d FROM ref)-730 AND start_date <= (SELECT d FROM ref)
  AND (p.product_id IS NULL OR p.product_id IN (SELECT product_id FROM product WHERE first_category='PROMO'))""",
)
def scan_promotions(t):
    return scans.scan_promotions(t, t.day(730), t.as_of, category="PROMO")


@query(
    "list_promotions",
    "SRC-7",
    f"""
SELECT {_PROMO}, store_name, product_name, first_category
FROM promotions p LEFT JOIN store s ON p.store_id=s.store_id LEFT JOIN product pr ON p.product_id=pr.product_id
WHERE (SELECT d FROM ref)-400 BETWEEN start_date AND end_date""",
)
def list_promotions(t):
    return scans.list_promotions(t, active_on=t.day(400))


@query("scan_holidays", "SRC-6 SRC-13", "SELECT date::VARCHAR AS date, holiday_name FROM holidays")
def scan_holidays(t):
    return scans.scan_holidays(t)


@query(
    "dimension_names",
    "SRC-8 FN-4",
    f"""
, k AS (SELECT CASE WHEN city_id % 5 = 0 THEN city_id + 1000 ELSE city_id END AS city_id, store_id, product_id,
    sum(sale_amount) AS a FROM sales GROUP BY ALL)
SELECT k.city_id, k.store_id, k.product_id, {q('a')} AS amount, coalesce(c.city_name, 'City ' || k.city_id) AS city_name,
  coalesce(store_name, 'Store ' || k.store_id) AS store_name, coalesce(product_name, 'Product ' || k.product_id) AS product_name
FROM k LEFT JOIN city c USING (city_id) LEFT JOIN store USING (store_id) LEFT JOIN product USING (product_id)""",
)
def dimension_names(t):
    # every fifth city id is made unknown, so that the fall-back label is used
    c = F.col("city_id")
    s = t.sales(category=False).withColumn("city_id", F.when(c % 5 == 0, c + 1000).otherwise(c))
    return scans.with_names(t, s.groupBy("city_id", "store_id", "product_id").agg(F.sum("sale_amount").alias("amount")))


@query(
    "valid_combinations",
    "SRC-20 SET-3 AGG-6",
    """
SELECT city_id, store_id, first_category, count(*) AS row_count FROM sales GROUP BY 1,2,3 HAVING count(*) >= 100""",
)
def valid_combinations(t):
    return scans.valid_combinations(t, 100)


@query(
    "curated_lists",
    "SRC-21 SRT-2 SET-2",
    """
(SELECT 'city' AS list, city_id::BIGINT AS id, count(*) AS n FROM store GROUP BY city_id)
UNION ALL (SELECT 'store', store_id, count(*) FROM lines GROUP BY store_id HAVING count(*)>100 ORDER BY 3 DESC, 2 LIMIT 25)
UNION ALL (SELECT 'product', product_id, count(*) FROM lines GROUP BY product_id HAVING count(*)>20 ORDER BY 3 DESC, 2 LIMIT 15)""",
)
def curated_lists(t):
    return scans.curated_lists(t, 100, 20)
