"""Registry of queries: name -> (survey ids, Spark callable, check SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.calendar import HOLIDAYS
from ..functions.core import HALF, settle
from ..sources.adapter import RetailTables

_HOLIDAY_CASE = " ".join(f"WHEN month({{d}})={m} AND day({{d}})={d} THEN '{n}'" for m, d, n in HOLIDAYS)


def holiday_sql(d: str) -> str:
    return "CASE " + _HOLIDAY_CASE.format(d=d) + " END"


def weather_sql(d: str, c: str) -> str:
    return f"""((dayofyear({d})*3 + {c}*7) % 36)::DOUBLE AS avg_temperature,
  (30 + (dayofyear({d})*5 + {c}*11) % 61)::DOUBLE AS avg_humidity,
  greatest((dayofyear({d}) + {c}*3) % 23 - 10, 0)::DOUBLE AS precpt,
  ((dayofyear({d})*2 + {c}) % 7)::DOUBLE AS avg_wind_level"""


# The canonical tables restated in plain SQL; the check SQL of a query starts from these.
PRELUDE = f"""
lines AS (
  SELECT CAST(l_shipdate AS DATE) AS sale_date, l_suppkey AS store_id, l_partkey AS product_id,
    sum(CAST(l_quantity AS BIGINT))::BIGINT AS units_sold,
    sum(CAST(l_extendedprice AS DECIMAL(12,2)))::DECIMAL(14,2) AS sale_amount,
    max(CAST(l_discount AS DECIMAL(4,2))) AS discount,
    max(CASE WHEN l_returnflag='R' THEN (l_orderkey+l_partkey)%17 ELSE 0 END)::INT AS stock_hour6_22_cnt
  FROM lineitem GROUP BY 1,2,3),
ref AS (SELECT max(CAST(l_shipdate AS DATE)) AS d FROM lineitem),
city AS (SELECT n_nationkey AS city_id, n_name AS city_name, r_regionkey AS region_id, r_name AS region_name
  FROM nation JOIN region ON n_regionkey=r_regionkey),
store AS (
  SELECT s_suppkey AS store_id, s_name AS store_name, s_nationkey AS city_id, n_name AS city_name, n_regionkey AS region_id,
    (20 + (s_nationkey*7) % 25 + (s_suppkey % 10)/10.0)::DOUBLE AS latitude,
    (100 + (s_nationkey*11) % 30 + ((s_suppkey*3) % 10)/10.0)::DOUBLE AS longitude,
    CASE s_suppkey % 3 WHEN 0 THEN 'express' WHEN 1 THEN 'hyper' ELSE 'super' END AS store_format
  FROM supplier JOIN nation ON s_nationkey=n_nationkey),
product AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_size % 7 AS management_group_id, p_type AS first_category,
    p_brand AS second_category, p_size AS third_category, CAST(p_retailprice AS DECIMAL(10,2)) AS list_price FROM part),
sales AS (
  SELECT l.*, st.city_id, st.region_id, p.* EXCLUDE (product_id, product_name),
    l.discount >= 0.05 AS activity_flag,
    ({holiday_sql('sale_date')}) IS NOT NULL AS holiday_flag,
    ((l.product_id*7 + l.store_id*3) % 200)::BIGINT AS stock_level,
    {weather_sql('sale_date', 'st.city_id')}
  FROM lines l JOIN store st ON l.store_id=st.store_id JOIN product p ON l.product_id=p.product_id),
hourly AS (
  SELECT s.sale_date, s.store_id, s.product_id, s.stock_hour6_22_cnt, h.hour_of_day::INT AS hour_of_day,
    (h.hour_of_day>=6 AND h.hour_of_day<22 AND h.hour_of_day-6<s.stock_hour6_22_cnt) AS is_out,
    CASE WHEN h.hour_of_day>=6 AND h.hour_of_day<22 AND h.hour_of_day-6<s.stock_hour6_22_cnt THEN 0.0::DOUBLE
      ELSE ((s.product_id + s.store_id*3 + dayofyear(s.sale_date) + h.hour_of_day*7) % 13)::DOUBLE END AS hour_sale
  FROM lines s, range(24) h(hour_of_day)),
sale_days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS sale_date FROM lineitem),
weather AS (
  SELECT city_id, date, {weather_sql('date', 'city_id')} FROM (
    SELECT DISTINCT s_nationkey AS city_id, CAST(l_shipdate AS DATE) AS date
    FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey)),
holidays AS (SELECT sale_date AS date, {holiday_sql('sale_date')} AS holiday_name FROM sale_days
  WHERE ({holiday_sql('sale_date')}) IS NOT NULL),
promotions AS (
  SELECT 'S' || s_suppkey AS promotion_id, s_suppkey AS store_id, NULL::BIGINT AS product_id,
    DATE '1995-01-01' + (s_suppkey*37 % 2400)::INT AS start_date,
    DATE '1995-01-01' + (s_suppkey*37 % 2400 + 6 + s_suppkey % 21)::INT AS end_date,
    CASE s_suppkey % 3 WHEN 0 THEN 'bogo' WHEN 1 THEN 'bundle' ELSE 'discount' END AS promotion_type,
    (5 + s_suppkey % 4 * 5)::INT AS discount_percentage FROM supplier
  UNION ALL
  SELECT 'P' || p_partkey, NULL, p_partkey, DATE '1995-01-01' + (p_partkey*53 % 2400)::INT,
    DATE '1995-01-01' + (p_partkey*53 % 2400 + 3 + p_partkey % 12)::INT,
    CASE p_partkey % 3 WHEN 0 THEN 'bogo' WHEN 1 THEN 'bundle' ELSE 'discount' END, (5 + p_partkey % 6 * 5)::INT FROM part
  UNION ALL
  SELECT 'R' || r_regionkey, NULL, NULL, DATE '1995-01-01' + (323 + r_regionkey*365)::INT,
    DATE '1995-01-01' + (323 + r_regionkey*365 + 6)::INT,
    CASE r_regionkey % 3 WHEN 0 THEN 'bogo' WHEN 1 THEN 'bundle' ELSE 'discount' END, 20 FROM region)
"""


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    build: Callable[[RetailTables], DataFrame]
    sql: str | None
    digits: int


REGISTRY: dict[str, Query] = {}


def q(expr: str, digits: int = 4) -> str:
    """Check-SQL form of the report rounding."""
    s = f"1e{digits}"
    return f"floor(({expr})::DOUBLE*{s}+{HALF})/{s}"


def corr_sql(x: str, y: str, cond: str | None = None) -> str:
    f = f" FILTER (WHERE {cond})" if cond else ""
    c = f"corr({x}::DOUBLE,{y}::DOUBLE){f}"
    return f"(CASE WHEN isnan({c}) THEN NULL ELSE {c} END)"


def query(name: str, ids: str, sql: str | None = None, digits: int = 4):
    """Registers a builder; ``sql`` continues the canonical WITH list (start with ``, cte AS`` or ``SELECT``)."""

    def register(fn):
        assert name not in REGISTRY, name
        full = None
        if sql is not None:
            body = sql.strip()
            full = "WITH " + PRELUDE.strip() + ("\n" if body.upper().startswith("SELECT") else "") + body
        REGISTRY[name] = Query(name, ids, fn, full, digits)
        return fn

    return register


def as_callable(item: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return settle(item.build(RetailTables(spark, sf_dir)), item.digits)

    run.__name__ = item.name
    return run
