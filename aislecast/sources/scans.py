"""Parameterised scans over the canonical tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import all_of
from .adapter import RetailTables


def _member(column: str, ids: Sequence | None):
    return F.col(column).isin(list(ids)) if ids is not None else None


def scan_sales(
    t: RetailTables,
    store_ids: Sequence[int] | None = None,
    product_ids: Sequence[int] | None = None,
    city_ids: Sequence[int] | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
    hourly: bool = False,
    stockouts: bool = True,
) -> DataFrame:
    """Sales with names of the three dimensions; optional id lists, inclusive date range, optional columns.

    The inner joins act as a referential filter.  The order date, store, product is the presentation order;
    callers that aggregate further need not pay for it, so it is left to ``ordered``.
    """
    sales = t.sales(since=start, until=end).filter(
        all_of([_member("store_id", store_ids), _member("product_id", product_ids), _member("city_id", city_ids)])
    )
    if hourly:
        sales = t.with_hours(sales)
    named = (
        sales.join(t.store.select("store_id", "store_name"), "store_id")
        .join(t.product.select("product_id", "product_name"), "product_id")
        .join(t.city.select("city_id", "city_name"), "city_id")
    )
    cols = [
        "sale_date", "store_id", "store_name", "city_id", "city_name", "product_id", "product_name",
        "first_category", "units_sold", "sale_amount", "discount", "holiday_flag", "activity_flag",
    ]
    if stockouts:
        cols.append("stock_hour6_22_cnt")
    if hourly:
        cols += ["hours_sale", "hours_stock_status"]
    return named.select(*cols)


def ordered(sales: DataFrame) -> DataFrame:
    return sales.orderBy("sale_date", "store_id", "product_id")


def scan_history(
    t: RetailTables, category: str | None = None, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Sales history under its forecasting names, optionally of one category."""
    pred = [F.col("first_category") == category if category is not None else None]
    return (
        t.sales(since=start, until=end)
        .filter(all_of(pred))
        .select(
            F.col("sale_date").alias("ds"),
            F.col("sale_amount").alias("y"),
            "store_id",
            "product_id",
            F.col("units_sold").alias("sale_qty"),
            F.col("activity_flag").alias("promo_flag"),
            "holiday_flag",
            F.col("stock_hour6_22_cnt").alias("stockout_hours"),
        )
    )


def scan_category_sales(
    t: RetailTables,
    category: str | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Sales with category and store names, LEFT joined to the weather of (date, city); optional page."""
    base = t.lines(start, end)
    sales = (
        base.join(t.store.select("store_id", "store_name", "city_id"), "store_id")
        .join(t.product.select("product_id", "first_category", "second_category"), "product_id")
        .filter(all_of([F.col("first_category") == category if category is not None else None]))
    )
    w = t.weather.withColumnRenamed("date", "sale_date")
    out = sales.join(w, ["sale_date", "city_id"], "left").select(
        "sale_date", "store_id", "store_name", "city_id", "product_id", "first_category", "second_category",
        "units_sold", "sale_amount", "avg_temperature", "precpt",
    )
    return out if limit is None else page(out, ["sale_date", "store_id", "product_id"], limit, offset)


def page(df: DataFrame, keys: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """One page under a total order."""
    return df.orderBy(*keys).offset(offset).limit(limit)


def scan_weather(
    t: RetailTables, city_id: int | None = None, start: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    d = F.col("date")
    pred = [
        F.col("city_id") == city_id if city_id is not None else None,
        d >= start if start is not None else None,
        d <= end if end is not None else None,
    ]
    return t.weather.filter(all_of(pred)).orderBy("city_id", "date")


def scan_promotions(
    t: RetailTables, start: dt.date, end: dt.date, category: str | None = None
) -> DataFrame:
    """Promotions whose interval overlaps [start, end]; a category restricts product promotions to its products."""
    hit = t.promotions.filter((F.col("end_date") >= F.lit(start)) & (F.col("start_date") <= F.lit(end)))
    if category is None:
        return hit
    products = t.product.filter(F.col("first_category") == category).select("product_id")
    wild = hit.filter(F.col("product_id").isNull())
    return wild.unionByName(hit.join(products, "product_id", "left_semi"))


def scan_holidays(t: RetailTables, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    d = F.col("date")
    return t.holidays.filter(all_of([d >= start if start else None, d <= end if end else None])).orderBy("date")


def list_promotions(
    t: RetailTables,
    store_id: int | None = None,
    product_id: int | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
    active_on: dt.date | None = None,
) -> DataFrame:
    """Promotions with product and store names, newest first; ``active_on`` keeps those running that day."""
    s, e = F.col("start_date"), F.col("end_date")
    pred = [
        F.col("store_id") == store_id if store_id is not None else None,
        F.col("product_id") == product_id if product_id is not None else None,
        s >= F.lit(start) if start is not None else None,
        e <= F.lit(end) if end is not None else None,
        F.lit(active_on).between(s, e) if active_on is not None else None,
    ]
    hit = t.promotions.filter(all_of(pred))
    return (
        hit.join(t.store.select("store_id", "store_name"), "store_id", "left")
        .join(t.product.select("product_id", "product_name", "first_category"), "product_id", "left")
        .orderBy(F.desc("start_date"), "promotion_id")
    )


def with_names(t: RetailTables, df: DataFrame) -> DataFrame:
    """City, store and product names, falling back to ``City 7`` where the dimension has no row."""

    def named(frame, dim, key, name, label):
        return frame.join(dim.select(key, name), key, "left").withColumn(
            name, F.coalesce(F.col(name), F.concat(F.lit(label + " "), F.col(key).cast("string")))
        )

    df = named(df, t.city, "city_id", "city_name", "City")
    df = named(df, t.store, "store_id", "store_name", "Store")
    return named(df, t.product, "product_id", "product_name", "Product")


def valid_combinations(t: RetailTables, min_rows: int, top: int | None = None) -> DataFrame:
    """(city, store, category) triples with at least ``min_rows`` rows, most rows first."""
    out = (
        t.sales()
        .groupBy("city_id", "store_id", "first_category")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter(F.col("row_count") >= min_rows)
    )
    if top is None:
        return out
    return out.orderBy(F.desc("row_count"), "city_id", "store_id", "first_category").limit(top)


def curated_lists(t: RetailTables, min_store_rows: int, min_product_rows: int, stores: int = 25, products: int = 15):
    """Short lists for selection: cities by stores, busiest stores, busiest products."""
    cities = t.store.groupBy("city_id").agg(F.count(F.lit(1)).alias("n"))
    lines = t.lines()

    def busiest(key, minimum, k):
        return (
            lines.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > minimum)
            .orderBy(F.desc("n"), key)
            .limit(k)
        )

    def tagged(df, kind, key):
        return df.select(F.lit(kind).alias("list"), F.col(key).cast("bigint").alias("id"), "n")

    return (
        tagged(cities, "city", "city_id")
        .unionByName(tagged(busiest("store_id", min_store_rows, stores), "store", "store_id"))
        .unionByName(tagged(busiest("product_id", min_product_rows, products), "product", "product_id"))
    )
