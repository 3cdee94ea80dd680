"""Canonical retail tables derived from the given warehouse tables.

Supplier = store, nation = city, part = product.  Weather, stock hours, stock level, hourly arrays,
store coordinates and promotions are not in the given tables; they are integer formulae of the keys
(a stand-in, stated as such), so they grow with the data and are equal in every engine.

Dimension joins carry no broadcast hint: the optimizer broadcasts a dimension only while its size is
under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles (with adaptive skew splitting) beyond it.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import holiday_name, is_holiday
from ..schemas import RAW
from ..session import bound_shares, deal_shuffles

HOURS = 24
CENT = Decimal("0.01")


def _money(cents: Column) -> Column:
    """Exact amount from whole cents."""
    return (cents.cast("decimal(14,0)") * F.lit(CENT)).cast("decimal(14,2)")


def _percent(points: Column) -> Column:
    return (points.cast("decimal(4,0)") * F.lit(CENT)).cast("decimal(4,2)")


def stock_level(product: Column, store: Column) -> Column:
    """Stand-in stock level of an item in a store."""
    return ((product * 7 + store * 3) % 200).cast("bigint")


def weather_columns(day: Column, city: Column) -> dict[str, Column]:
    """Stand-in weather of a city and day."""
    doy = F.dayofyear(day)
    return {
        "avg_temperature": ((doy * 3 + city * 7) % 36).cast("double"),
        "avg_humidity": (30 + (doy * 5 + city * 11) % 61).cast("double"),
        "precpt": F.greatest((doy + city * 3) % 23 - 10, F.lit(0)).cast("double"),
        "avg_wind_level": ((doy * 2 + city) % 7).cast("double"),
    }


class RetailTables:
    """Lazily built canonical frames over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        bound_shares(spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def as_of(self) -> dt.date:
        """Reference date: the last sale date (one value; read from one pruned column)."""
        return self.raw("lineitem").agg(F.max("l_shipdate").cast("date")).first()[0]

    def day(self, back: int) -> dt.date:
        return self.as_of - dt.timedelta(days=back)

    # ---- dimensions -------------------------------------------------------------------------

    @cached_property
    def city(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return n.join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("n_nationkey").alias("city_id"),
            F.col("n_name").alias("city_name"),
            F.col("r_regionkey").alias("region_id"),
            F.col("r_name").alias("region_name"),
        )

    @cached_property
    def store(self) -> DataFrame:
        s, n = self.raw("supplier"), self.raw("nation")
        key, city = F.col("s_suppkey"), F.col("s_nationkey")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            key.alias("store_id"),
            F.col("s_name").alias("store_name"),
            city.alias("city_id"),
            F.col("n_name").alias("city_name"),
            F.col("n_regionkey").alias("region_id"),
            (20 + (city * 7) % 25 + (key % 10) / 10).cast("double").alias("latitude"),
            (100 + (city * 11) % 30 + ((key * 3) % 10) / 10).cast("double").alias("longitude"),
            F.element_at(F.array(*map(F.lit, ("express", "hyper", "super"))), (key % 3 + 1).cast("int")).alias("store_format"),
        )

    @cached_property
    def product(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            (F.col("p_size") % 7).alias("management_group_id"),
            F.col("p_type").alias("first_category"),
            F.col("p_brand").alias("second_category"),
            F.col("p_size").alias("third_category"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("list_price"),
        )

    # ---- facts ------------------------------------------------------------------------------

    @cached_property
    def _scans(self) -> int:
        """Parts in which the order lines are read."""
        return self.raw("lineitem").rdd.getNumPartitions()

    def _raw_lines(self, since: dt.date | None, until: dt.date | None) -> DataFrame:
        """Order lines under canonical names, money as whole cents, bounded by date.

        The date bounds apply to the raw timestamp, so they reach the parquet scan.
        """
        deal_shuffles(self.spark, self._scans)
        li = self.raw("lineitem")
        ts = F.col("l_shipdate")
        if since is not None:
            li = li.filter(ts >= F.lit(dt.datetime.combine(since, dt.time())).cast(li.schema["l_shipdate"].dataType))
        if until is not None:
            after = dt.datetime.combine(until + dt.timedelta(days=1), dt.time())
            li = li.filter(ts < F.lit(after).cast(li.schema["l_shipdate"].dataType))
        returned = F.when(F.col("l_returnflag") == "R", (F.col("l_orderkey") + F.col("l_partkey")) % 17).otherwise(0)
        return li.select(
            ts.cast("date").alias("sale_date"),
            F.col("l_suppkey").alias("store_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("units"),
            F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
            F.rint(F.col("l_discount") * 100).cast("int").alias("discount_pct"),
            returned.cast("int").alias("stock_hours"),
        )

    def lines(self, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
        """Sales at the grain (sale_date, store_id, product_id); duplicate lines are summed in whole cents."""
        return (
            self._raw_lines(since, until)
            .groupBy("sale_date", "store_id", "product_id")
            .agg(
                F.sum("units").alias("units_sold"),
                _money(F.sum("cents")).alias("sale_amount"),
                _percent(F.max("discount_pct")).alias("discount"),
                F.max("stock_hours").alias("stock_hour6_22_cnt"),
            )
        )

    def pairs(self) -> DataFrame:
        """The distinct (store_id, product_id) that have ever sold, from the two columns of the order lines."""
        return self._raw_lines(None, None).select("store_id", "product_id").distinct()

    def sales(
        self,
        geo: bool = True,
        category: bool = True,
        since: dt.date | None = None,
        until: dt.date | None = None,
    ) -> DataFrame:
        """Canonical sales; ``geo`` joins the store (and adds weather), ``category`` joins the product."""
        df = self.lines(since, until)
        if geo:
            df = df.join(self.store.select("store_id", "city_id", "region_id"), "store_id")
        if category:
            df = df.join(self.product.drop("product_name"), "product_id")
        d = F.col("sale_date")
        cols = {
            "activity_flag": F.col("discount") >= 0.05,
            "holiday_flag": is_holiday(d),
            "stock_level": stock_level(F.col("product_id"), F.col("store_id")),
        }
        if geo:
            cols.update(weather_columns(d, F.col("city_id")))
        return df.withColumns(cols)

    def with_hours(self, sales: DataFrame) -> DataFrame:
        """Adds ``hours_sale`` and ``hours_stock_status`` (24 slots; status 0 = out of stock)."""
        hours = F.sequence(F.lit(0), F.lit(HOURS - 1))
        cnt = F.col("stock_hour6_22_cnt")
        out = lambda h: (h >= 6) & (h < 22) & (h - 6 < cnt)
        weight = lambda h: (
            (F.col("product_id") + F.col("store_id") * 3 + F.dayofyear("sale_date") + h * 7) % 13
        ).cast("double")
        return sales.withColumns(
            {
                "hours_sale": F.transform(hours, lambda h: F.when(out(h), 0.0).otherwise(weight(h))),
                "hours_stock_status": F.transform(hours, lambda h: F.when(out(h), 0).otherwise(1)),
            }
        )

    def daily(self, *keys: str, since: dt.date | None = None, geo: bool = True, category: bool = True) -> DataFrame:
        """Daily series per key: every group is bounded by the calendar, whatever the share of a key.

        Sums and maxima do not need the row grain, so the order lines are aggregated directly: one shuffle
        of partial results, and a dimension is joined only when a key comes from it.
        """
        rows = self._raw_lines(since, None)
        if geo and ({"city_id", "region_id"} & set(keys)):
            rows = rows.join(self.store.select("store_id", "city_id", "region_id"), "store_id")
        if category and not set(keys) <= {"store_id", "product_id", "city_id", "region_id"}:
            rows = rows.join(self.product.drop("product_name"), "product_id")
        out = rows.groupBy(*keys, "sale_date").agg(
            F.sum("units").alias("units_sold"),
            _money(F.sum("cents")).alias("sale_amount"),
            F.max("stock_hours").alias("stock_hours"),
            F.max(stock_level(F.col("product_id"), F.col("store_id"))).alias("stock_level"),
            _percent(F.max("discount_pct")).alias("discount"),
        )
        return out.withColumns(
            {"activity_flag": F.col("discount") >= 0.05, "holiday_flag": is_holiday(F.col("sale_date"))}
        )

    # ---- side tables ------------------------------------------------------------------------

    @cached_property
    def sale_days(self) -> DataFrame:
        """Distinct sale dates: bounded by the calendar."""
        return self.raw("lineitem").select(F.col("l_shipdate").cast("date").alias("sale_date")).distinct()

    @cached_property
    def weather(self) -> DataFrame:
        """One row per city and day with sales."""
        s = self.raw("lineitem").select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("store_id"))
        s = s.distinct().join(self.store.select("store_id", "city_id"), "store_id").select("city_id", "date").distinct()
        return s.withColumns(weather_columns(F.col("date"), F.col("city_id")))

    @cached_property
    def holidays(self) -> DataFrame:
        name = holiday_name(F.col("sale_date"))
        return self.sale_days.select(F.col("sale_date").alias("date"), name.alias("holiday_name")).filter(
            F.col("holiday_name").isNotNull()
        )

    @cached_property
    def promotions(self) -> DataFrame:
        """Stand-in promotions per store, per product and (both ids NULL) per region; ends are inclusive."""
        kinds = F.array(*map(F.lit, ("bogo", "bundle", "discount")))

        def build(df, key, prefix, store, product, start, length, percent):
            k = F.col(key).cast("bigint")
            first = F.date_add(F.lit(dt.date(1995, 1, 1)), start(k).cast("int"))
            return df.select(
                F.concat(F.lit(prefix), k.cast("string")).alias("promotion_id"),
                (k if store else F.lit(None).cast("bigint")).alias("store_id"),
                (k if product else F.lit(None).cast("bigint")).alias("product_id"),
                first.alias("start_date"),
                F.date_add(first, length(k).cast("int")).alias("end_date"),
                F.element_at(kinds, (k % 3 + 1).cast("int")).alias("promotion_type"),
                percent(k).cast("int").alias("discount_percentage"),
            )

        per_store = build(
            self.raw("supplier"), "s_suppkey", "S", True, False,
            lambda k: k * 37 % 2400, lambda k: 6 + k % 21, lambda k: 5 + k % 4 * 5,
        )
        per_product = build(
            self.raw("part"), "p_partkey", "P", False, True,
            lambda k: k * 53 % 2400, lambda k: 3 + k % 12, lambda k: 5 + k % 6 * 5,
        )
        per_region = build(
            self.raw("region"), "r_regionkey", "R", False, False,
            lambda k: 323 + k * 365, lambda k: 6 + k * 0, lambda k: 20 + k * 0,
        )
        return per_store.unionByName(per_product).unionByName(per_region)

    def stockout_events(self, sales: DataFrame) -> DataFrame:
        """Stock-out intervals, from 6:00 for the counted hours, with the sales lost pro rata."""
        start = F.col("sale_date").cast("timestamp_ntz") + F.expr("INTERVAL 6 HOURS")
        hours = F.col("stock_hour6_22_cnt")
        return sales.filter(hours > 0).select(
            "store_id",
            "product_id",
            "sale_date",
            start.alias("start_time"),
            (start + F.make_dt_interval(hours=hours)).alias("end_time"),
            hours.alias("duration_hours"),
            (F.col("sale_amount").cast("double") * hours / 16).alias("estimated_lost_sales"),
        )
