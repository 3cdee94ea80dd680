"""Explicit schemas: the given tables (no footer inference at scan time) and the canonical sales frame."""

from __future__ import annotations

RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
}

# Daily sales file layout: 17 columns in file order.
DAILY_SALES_CSV = (
    "city_id int, store_id int, management_group_id int, first_category_id int, second_category_id int, "
    "third_category_id int, product_id int, dt date, sale_amount double, stock_hour6_22_cnt int, discount double, "
    "holiday_flag int, activity_flag int, precpt double, avg_temperature double, avg_humidity double, "
    "avg_wind_level double"
)

SALES = (
    "sale_date date, store_id bigint, product_id bigint, city_id int, first_category string, units_sold bigint, "
    "sale_amount decimal(14,2), discount decimal(4,2), activity_flag boolean, holiday_flag boolean, "
    "stock_hour6_22_cnt int, stock_level bigint, precpt double, avg_temperature double, avg_humidity double, "
    "avg_wind_level double"
)
