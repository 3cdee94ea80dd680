"""File ingest, normalising, subsets and tables derived from raw rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DAILY_SALES_CSV

# Default names handed out in turn to holiday dates; a parameter of ``normalise``.
CYCLIC_HOLIDAYS = (
    "New Year", "Spring Festival", "Lantern Festival", "Tomb Sweeping Day", "Labour Day",
    "Dragon Boat Festival", "Mid-Autumn Festival", "National Day", "Double Ninth Festival", "Winter Solstice",
)


def read_daily_sales(spark: SparkSession, path: str, schema: str | T.StructType = DAILY_SALES_CSV) -> DataFrame:
    """Daily sales from one CSV file or a folder of chunks with a header; quoted commas are kept, bad cells are NULL."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", quote='"', escape='"', dateFormat="yyyy-MM-dd")


def read_hierarchy(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')


def day_index(sales: DataFrame, start: dt.date = dt.date(2022, 1, 1), day: str = "sale_date") -> DataFrame:
    """Each distinct date with its new date: ``start`` plus its dense position (a calendar-sized frame)."""
    days = sales.select(day).distinct()
    pos = F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy(day)) - 1
    return days.select(day, F.date_add(F.lit(start), pos).alias("dt"))


def normalise(sales: DataFrame, city: DataFrame, store: DataFrame, product: DataFrame, names: Sequence[str] = CYCLIC_HOLIDAYS) -> DataFrame:
    """Sales in the interchange layout: gap-free dates, arrays as JSON text, cyclic holiday names, ids with names; 17 columns."""
    days = day_index(sales)
    held = sales.filter("holiday_flag").select("sale_date").distinct()
    order = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("sale_date")) - 1
    labels = F.array(*map(F.lit, names))
    named = held.select("sale_date", F.element_at(labels, (F.pmod(order, F.lit(len(names))) + 1).cast("int")).alias("holiday_name"))
    out = sales.join(days, "sale_date").join(named, "sale_date", "left")
    out = (
        out.join(city.select("city_id", "city_name"), "city_id", "left")
        .join(store.select("store_id", "store_name"), "store_id", "left")
        .join(product.select("product_id", "product_name"), "product_id", "left")
    )
    return out.select(
        "dt", "city_id", "city_name", "store_id", "store_name", "product_id", "product_name", "first_category",
        "sale_amount", "units_sold", "discount", "stock_hour6_22_cnt",
        F.to_json("hours_sale").alias("hours_sale"), F.to_json("hours_stock_status").alias("hours_stock_status"),
        F.col("activity_flag").cast("int").alias("activity_flag"), "holiday_name", "avg_temperature",
    )


def extract_subset(sales: DataFrame, cities: int, stores: int, products: int) -> dict[str, DataFrame]:
    """The first ids of each dimension, the sales among them, and dimensions from the first row per id."""

    def first(df, key, n):
        return df.select(key).distinct().orderBy(key).limit(n)

    kept = sales.join(first(sales, "city_id", cities), "city_id", "left_semi")
    kept = kept.join(first(kept, "store_id", stores), "store_id", "left_semi")
    kept = kept.join(first(kept, "product_id", products), "product_id", "left_semi")
    row = F.struct("sale_date", "store_id", "product_id")
    store = kept.groupBy("store_id").agg(F.min_by("city_id", row).alias("city_id"))
    product = kept.groupBy("product_id").agg(F.min_by("first_category", row).alias("first_category"))
    return {"sales": kept, "store": store, "product": product}


def derive_tables(sales: DataFrame) -> dict[str, DataFrame]:
    """Dimension, weather, holiday and promotion tables from raw sales rows by de-duplication."""
    weather = sales.groupBy("city_id", F.col("sale_date").alias("date")).agg(
        *[F.avg(c).alias(c) for c in ("avg_temperature", "avg_humidity", "precpt", "avg_wind_level")]
    )
    return {
        "city": sales.select("city_id", "region_id").dropDuplicates(["city_id"]),
        "store": sales.select("store_id", "city_id").dropDuplicates(["store_id"]),
        "product": sales.select("product_id", "first_category", "second_category").dropDuplicates(["product_id"]),
        "weather": weather,
        "holidays": sales.filter("holiday_flag").select(F.col("sale_date").alias("date")).distinct(),
        "promotions": sales.filter("activity_flag")
        .groupBy("store_id", "product_id", "sale_date")
        .agg(F.max("discount").alias("discount")),
    }
