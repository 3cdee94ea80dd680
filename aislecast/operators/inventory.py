"""Lost demand, inventory status, transfers between stores, stock-out risk and stock targets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import clamp, ladder, mean_if, mean_of, ratio, share_if, slope_of, stable_bucket, std_of  # noqa: F401
from ..functions.geo import EARTH_KM, haversine_km
from ..session import written
from .ranking import exact_quantiles
from .series import pct_change, tail_rank

OPEN_HOURS = 16
Z_SCORES = {0.90: 1.28, 0.95: 1.64, 0.99: 2.33}
PRIORITY_RANK = {"immediate": 4, "high": 3, "medium": 2, "low": 1}
BLOCK = 8  # cells of a side of a block
URGENCY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def whole(c: Column) -> Column:
    """Integer part, towards zero."""
    return c.cast("bigint")


def label_rank(c: str, ranks: dict[str, int], default: int) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(c)), F.lit(default))


# ---- lost demand ----------------------------------------------------------------------------


def lost_demand_by_hours(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Demand scaled up by the closed hours where the series has any in-stock day; loss never negative."""
    h, amount = F.col("stock_hour6_22_cnt"), F.col("sale_amount").cast("double")
    known = sales.filter(h == 0).select(*keys).distinct().withColumn("_known", F.lit(True))
    factor = F.when(h < OPEN_HOURS, F.lit(float(OPEN_HOURS)) / (OPEN_HOURS - h)).otherwise(2.0)
    out = sales.join(known, list(keys), "left")
    est = F.when((h > 0) & F.col("_known").isNotNull(), amount * factor).otherwise(amount)
    return out.withColumn("estimated_demand", est).withColumn(
        "lost_sales", F.greatest(F.lit(0.0), F.col("estimated_demand") - amount)
    ).drop("_known")


def weekday_medians(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median in-stock amount by weekday of each series."""
    stocked = sales.filter(F.col("stock_hour6_22_cnt") == 0).withColumn("day_of_week", F.weekday("sale_date"))
    return exact_quantiles(stocked, "sale_amount", {"median_amount": 0.5}, [*keys, "day_of_week"])


def lost_demand_summary(lost: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = F.col("stock_hour6_22_cnt") > 0
    return lost.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_days"),
        F.count_if(out).alias("stockout_days"),
        share_if(out).alias("stockout_rate"),
        F.sum("lost_sales").alias("total_lost_sales"),
        F.coalesce(F.avg(F.when(out, F.col("lost_sales"))), F.lit(0.0)).alias("avg_lost_sales"),
    )


def lost_demand_by_weekday(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stock-out rows against the mean of in-stock days of the same weekday."""
    h = F.col("stock_hour6_22_cnt")
    dow = sales.withColumn("day_of_week", F.weekday("sale_date"))
    base = dow.filter(h == 0).groupBy(*keys, "day_of_week").agg(mean_of("sale_amount").alias("estimated_demand"))
    return dow.filter(h > 0).join(base, [*keys, "day_of_week"], "left").withColumn(
        "lost_sales",
        F.when(
            F.col("estimated_demand").isNotNull(),
            F.greatest(F.lit(0.0), F.col("estimated_demand") - F.col("sale_amount").cast("double")),
        ),
    )


def estimate_stockout_demand(
    sales: DataFrame, keys: Sequence[str], start: dt.date, end: dt.date, back: int = 28
) -> DataFrame:
    """Demand of stock-out days in [start, end]: weekday mean of in-stock days in the ``back`` days before, else 0."""
    h, d = F.col("stock_hour6_22_cnt"), F.col("sale_date")
    dow = sales.withColumn("day_of_week", F.weekday("sale_date"))
    window = d.between(F.lit(start - dt.timedelta(days=back)), F.lit(start - dt.timedelta(days=1)))
    base = dow.filter(window & (h == 0)).groupBy(*keys, "day_of_week").agg(mean_of("sale_amount").alias("_m"))
    out = dow.filter(d.between(F.lit(start), F.lit(end)) & (h > 0))
    return out.join(base, [*keys, "day_of_week"], "left").select(
        *keys, "sale_date", F.coalesce("_m", F.lit(0.0)).alias("estimated_demand")
    )


# ---- status and transfers --------------------------------------------------------------------


def inventory_status(
    sales: DataFrame,
    store: DataFrame,
    item: str = "product_id",
    min_rows: int = 14,
    safety: float = 1.5,
    overstock_days: float = 30,
    unit_price: float = 25.0,
) -> DataFrame:
    """Stock position per store and item with safety stock, cover in days and status."""
    m = (
        sales.groupBy("store_id", item)
        .agg(
            mean_of("units_sold").alias("avg_daily_sales"),
            std_of("units_sold").alias("sales_stddev"),
            F.max("stock_level").alias("current_stock"),
            F.min("stock_level").alias("min_stock_level"),
            F.count(F.lit(1)).alias("days_data"),
            (F.sum("units_sold") * unit_price).alias("total_revenue"),
        )
        .filter(F.col("days_data") >= min_rows)
        .join(store.select("store_id", "city_id", "latitude", "longitude"), "store_id")
    )
    avg, stock = F.col("avg_daily_sales"), F.col("current_stock")
    m = m.withColumns(
        {
            "safety_stock": F.when(F.col("sales_stddev") > 0, avg * safety).otherwise(avg * 2),
            "days_of_inventory": F.when(avg > 0, stock / avg).otherwise(999.0),
        }
    )
    return m.withColumn(
        "stock_status",
        F.when((avg > 0) & (stock <= F.col("safety_stock")), "stockout_risk")
        .when((avg > 0) & (stock > avg * overstock_days), "overstock")
        .otherwise("normal"),
    )


def store_profiles(sales: DataFrame, min_rows: int = 30, unit_price: float = 25.0) -> DataFrame:
    """Turnover, low and excess stock, value and efficiency ladder per store."""
    p = (
        sales.groupBy("store_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_distinct("product_id").alias("total_products"),
            mean_of("stock_level").alias("avg_stock_level"),
            ratio(F.sum("units_sold"), F.nullif(F.sum("stock_level"), F.lit(0))).alias("turnover"),
            F.count_if(F.col("stock_level") <= 5).alias("low_stock_products"),
            F.count_if(F.col("stock_level") > F.col("units_sold") * 30).alias("overstock_products"),
            (F.sum("stock_level") * unit_price).alias("inventory_value"),
        )
        .filter(F.col("_n") >= min_rows)
        .drop("_n")
    )
    turn = F.col("turnover")
    healthy = (turn > 0.1) & (F.col("low_stock_products") < F.col("total_products") * 0.1)
    return p.withColumn(
        "efficiency_score", F.when(healthy, 90 + turn * 100).when(turn > 0.05, 70 + turn * 200).otherwise(50.0)
    )


def _cells(df: DataFrame, km: float) -> DataFrame:
    """Cube cell of the position on the sphere; points within ``km`` lie in the same or a touching cell."""
    lat, lon = F.radians("latitude"), F.radians("longitude")
    axes = {"_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)}
    return df.withColumns({k: F.floor(v * (EARTH_KM / km)) for k, v in axes.items()})


def _reaching(src: DataFrame, dst: DataFrame, item: str) -> DataFrame:
    """``src`` once for each cell of ``dst`` with the same item that touches its own or is it, that cell in place of its own.

    The cells of ``dst`` are listed by blocks of ``BLOCK`` cells a side, so a row goes to the few blocks around it, not to 27 cells.
    """
    axes = ["_x", "_y", "_z"]
    place = [F.floor(F.col(c) / BLOCK).alias(f"{c}_block") for c in axes]
    blocks = [f"{c}_block" for c in axes]
    taken = dst.select(item, *axes).distinct().groupBy(item, *place).agg(F.collect_list(F.struct(*axes)).alias("_taken"))
    around = src
    for c, b in zip(axes, blocks):
        around = around.withColumn(b, F.explode(F.sequence(F.floor((F.col(c) - 1) / BLOCK), F.floor((F.col(c) + 1) / BLOCK))))
    touching = F.filter("_taken", lambda t: (F.abs(t["_x"] - F.col("_x")) <= 1) & (F.abs(t["_y"] - F.col("_y")) <= 1) & (F.abs(t["_z"] - F.col("_z")) <= 1))
    met = around.join(taken, [item, *blocks]).withColumn("_cell", F.explode(touching))
    return met.withColumns({c: F.col(f"_cell.{c}") for c in axes}).drop("_taken", "_cell", *blocks)


def _met_in_parts(left: DataFrame, right: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``; a key of more than ``most`` pairs is cut into parts by hashes of the stores.

    Keys are counted first. A side is cut until the pairs of a part fit, the larger side more often, and the other side goes to
    each of its parts, so every pair meets in one part.
    """
    sides = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), list(keys))
    n, m = F.col("_n").cast("double"), F.col("_m").cast("double")
    edge = float(most) ** 0.5
    part = lambda own, other: F.ceil(own / F.least(own, F.greatest(F.lit(edge), most / other)))
    crowded = sides.filter(n * m > most).select(*keys, part(n, m).alias("_p"), part(m, n).alias("_q"))

    def parts(df: DataFrame, store: str, own: str, other: str) -> DataFrame:
        cut = df.join(crowded, list(keys), "left").withColumns({"_p": F.coalesce("_p", F.lit(1)), "_q": F.coalesce("_q", F.lit(1))})
        cut = cut.withColumn(f"{own}_part", F.pmod(F.xxhash64(store), F.col(own)))
        return cut.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("_p", "_q")

    return parts(left, "store_id", "_p", "_q").join(parts(right, "t_store_id", "_q", "_p"), [*keys, "_p_part", "_q_part"]).drop("_p_part", "_q_part")


def transfer_opportunities(
    status: DataFrame,
    item: str = "product_id",
    cost_per_km: float = 0.5,
    max_cost: float = 100.0,
    min_quantity: float = 5.0,
    min_score: float = 60.0,
    shortage_days: float = 3.0,
    excess_days: float = 30.0,
    unit_price: float = 25.0,
    cell_pairs: int = 250_000,
) -> DataFrame:
    """Moves of one item from an overstocked store to a short one within the affordable distance.

    The cost limit is a radius, so stores meet only through touching cells of that size: candidates are
    neighbours of the same item, never all pairs of an item's stores, and cells without a short store take no part.  A cell with more than ``cell_pairs`` candidates is
    split into parts, so that one item in one place is many tasks.
    """
    radius = max_cost / cost_per_km
    cols = ["store_id", item, "city_id", "latitude", "longitude", "current_stock", "safety_stock", "avg_daily_sales", "days_of_inventory"]
    over = (F.col("stock_status") == "overstock") & (F.col("days_of_inventory") > excess_days)
    under = (F.col("stock_status") == "stockout_risk") & (F.col("days_of_inventory") < shortage_days)
    chosen = written(status.filter(over | under).select(*cols, "stock_status"))  # read by counts, cells and pairs of both sides
    src = _cells(chosen.filter(over).select(*cols), radius)
    dst = _cells(chosen.filter(under).select(*cols), radius)
    reach = _reaching(src, dst, item).select(*cols, "_x", "_y", "_z")
    short = dst.select(*[F.col(c).alias("t_" + c) for c in cols if c != item], item, "_x", "_y", "_z")
    pairs = _met_in_parts(reach, short, [item, "_x", "_y", "_z"], cell_pairs).filter(F.col("store_id") != F.col("t_store_id"))
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("t_latitude"), F.col("t_longitude"))
    out = pairs.withColumns(
        {
            "transfer_cost": km * cost_per_km,
            "quantity": F.least(
                F.greatest(F.lit(0.0), F.col("current_stock") - F.col("safety_stock")),
                F.greatest(F.lit(0.0), F.col("t_safety_stock") - F.col("t_current_stock")),
            ),
        }
    ).filter((F.col("transfer_cost") <= max_cost) & (F.col("quantity") >= min_quantity))
    cost, qty = F.col("transfer_cost"), F.col("quantity")
    score = clamp(
        F.greatest(F.lit(0.0), (shortage_days - F.col("t_days_of_inventory")) * 10)
        + F.greatest(F.lit(0.0), (F.col("days_of_inventory") - excess_days) * 2)
        + qty * unit_price / F.greatest(cost, F.lit(1.0)) * 10
        - F.least(F.lit(20.0), cost * 0.2),
        0,
        100,
    )
    days = F.col("t_days_of_inventory")
    out = out.withColumn("optimization_score", score).filter(F.col("optimization_score") >= min_score)
    out = out.withColumns(
        {
            "revenue_impact": F.least(qty, F.col("t_avg_daily_sales") * 7) * unit_price,
            "urgency_level": F.when(days <= 1, 5).when(days <= 2, 4).when(days <= 3, 3).when(
                F.col("days_of_inventory") > 45, 3
            ).otherwise(2),
        }
    )
    s, u = F.col("optimization_score"), F.col("urgency_level")
    priority = (
        F.when((u >= 4) & (s >= 80), "immediate")
        .when((u >= 3) & (s >= 70), "high")
        .when((s >= 60) | (F.col("revenue_impact") >= 500), "medium")
        .otherwise("low")
    )
    return out.select(
        F.col("store_id").alias("source_store_id"),
        F.col("t_store_id").alias("target_store_id"),
        item,
        "city_id",
        whole(qty).alias("quantity"),
        "optimization_score",
        "revenue_impact",
        "transfer_cost",
        "urgency_level",
        priority.alias("priority"),
        ratio("revenue_impact", F.greatest(cost, F.lit(1.0))).alias("roi"),
    )


def top_transfers(transfers: DataFrame, item: str = "product_id", k: int = 50) -> DataFrame:
    return transfers.orderBy(
        label_rank("priority", PRIORITY_RANK, 0).desc(),
        F.desc("optimization_score"),
        F.desc("revenue_impact"),
        "source_store_id",
        "target_store_id",
        item,
    ).limit(k)


def store_transfer_summary(transfers: DataFrame) -> DataFrame:
    """Both roles of every store in one list, then one line per store."""
    cols = ["optimization_score", "revenue_impact", "priority"]
    roles = transfers.select(F.col("source_store_id").alias("store_id"), F.lit("source").alias("role"), *cols).unionByName(
        transfers.select(F.col("target_store_id").alias("store_id"), F.lit("target").alias("role"), *cols)
    )
    return roles.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("total_opportunities"),
        F.count_if(F.col("role") == "source").alias("as_source"),
        F.count_if(F.col("role") == "target").alias("as_target"),
        F.sum("revenue_impact").alias("total_potential_revenue"),
        F.count_if(F.col("priority").isin("immediate", "high")).alias("high_priority_count"),
    )


def city_transfer_overview(transfers: DataFrame, item: str = "product_id") -> DataFrame:
    return transfers.groupBy("city_id").agg(
        F.count(F.lit(1)).alias("total_opportunities"),
        F.count_distinct("source_store_id").alias("stores_with_excess"),
        F.count_distinct("target_store_id").alias("stores_with_shortage"),
        F.count_distinct(item).alias("products_affected"),
        F.sum("quantity").alias("total_units"),
        F.sum("revenue_impact").alias("total_revenue_potential"),
        F.avg("optimization_score").alias("avg_score"),
        F.count_if(F.col("priority") == "immediate").alias("immediate_count"),
        F.count_if(F.col("priority") == "high").alias("high_count"),
    )


def balance_scores(status: DataFrame, item: str = "product_id") -> DataFrame:
    """Balance of surplus and deficit stores per city and item, 0 to 100; only where both occur."""
    counts = status.groupBy("city_id", item).agg(
        F.count_if(F.col("stock_status") == "overstock").alias("surplus_stores"),
        F.count_if(F.col("stock_status") == "stockout_risk").alias("deficit_stores"),
    ).filter((F.col("surplus_stores") > 0) & (F.col("deficit_stores") > 0))
    s, d = F.col("surplus_stores"), F.col("deficit_stores")
    return counts.withColumn(
        "balance_score", clamp(F.least(s / d, d / s) * 50 + F.least(s + d, F.lit(10)) * 3, 0, 100)
    )


# ---- risk ------------------------------------------------------------------------------------

RISK_LEVELS = [(0.8, "critical"), (0.6, "high"), (0.4, "medium"), (0.2, "low")]


def assess_risk(daily: DataFrame, keys: Sequence[str], min_rows: int = 30, service_level: float = 0.95) -> DataFrame:
    """Composite stock-out risk of each series from its history and its last two weeks."""
    ranked = tail_rank(pct_change(daily, keys, "sale_amount"), keys)
    r, amount, hours = F.col("from_end"), F.col("sale_amount"), F.col("stock_hours")

    def tail(n, value):
        return F.when(r <= n, value)

    # the first change inside a tail of n rows starts at its second row
    base = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        share_if(hours > 0).alias("stockout_frequency"),
        F.coalesce(F.avg(tail(13, F.col("pct_change"))), F.lit(0.0)).alias("recent_trend"),
        F.coalesce(ratio(std_of(tail(14, amount)), mean_of(tail(14, amount))), F.lit(0.0)).alias("demand_volatility"),
        (1 - mean_of(tail(14, hours)) / OPEN_HOURS).alias("stock_proxy"),
        mean_of(amount).alias("_mean"),
        std_of(amount).alias("_std"),
        mean_of(tail(7, amount)).alias("_mean7"),
        F.coalesce(F.avg(tail(6, F.col("pct_change"))), F.lit(0.0)).alias("_trend7"),
        (1 - mean_of(tail(7, hours)) / OPEN_HOURS).alias("_proxy7"),
    ).filter(F.col("rows") >= min_rows)
    up = F.greatest(F.lit(0.0), F.col("recent_trend"))
    cover = F.col("_proxy7") * F.col("_mean7") * 7
    days = F.when(
        F.col("_mean7") > 0,
        F.when(F.col("_trend7") > 0, cover / (F.col("_mean7") * (1 + F.col("_trend7")))).otherwise(cover / F.col("_mean7")),
    )
    return base.withColumns(
        {
            "lead_time_risk": up * 2,
            "risk_score": F.col("stockout_frequency") * 0.3
            + (1 - F.col("stock_proxy")) * 0.25
            + F.col("demand_volatility") * 0.2
            + up * 0.15
            + up * 2 * 0.1,
            "safety_stock": safety_stock(F.col("_std"), F.col("_mean"), service_level),
            "days_until_stockout": F.when(days > 0, F.greatest(F.lit(1).cast("bigint"), whole(days))),
        }
    ).withColumn("risk_level", ladder("risk_score", RISK_LEVELS, "minimal")).drop("_mean", "_std", "_mean7", "_trend7", "_proxy7")


def safety_stock(std: Column, mean: Column, service_level: float = 0.95, lead_days: float = 3) -> Column:
    """z * deviation * sqrt(lead time), at least a tenth of the mean."""
    z = Z_SCORES.get(service_level, 1.64)
    return F.greatest(z * std * F.sqrt(F.lit(float(lead_days))), mean * 0.1)


def reorder_list(risk: DataFrame, keys: Sequence[str], levels: Sequence[str] = ("critical", "high")) -> DataFrame:
    """Series to reorder, most urgent first."""
    hit = risk.filter(F.col("risk_level").isin(list(levels)))
    return hit.select(
        *keys,
        F.when(F.col("risk_level") == "critical", "immediate").otherwise("high").alias("urgency"),
        "risk_level",
        (F.col("safety_stock") * 2).alias("reorder_quantity"),
        "days_until_stockout",
        "risk_score",
    ).orderBy(F.desc("risk_score"), *keys)


def early_warnings(risk: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per triggered rule: critical risk, volatility above 1, trend above 20 %."""
    rules = F.array(
        F.when(F.col("risk_level") == "critical", F.struct(F.lit("critical_stockout_risk").alias("alert_type"), F.lit("critical").alias("severity"), F.col("risk_score").alias("value"))),
        F.when(F.col("demand_volatility") > 1.0, F.struct(F.lit("high_demand_volatility").alias("alert_type"), F.lit("warning").alias("severity"), F.col("demand_volatility").alias("value"))),
        F.when(F.col("recent_trend") > 0.2, F.struct(F.lit("rapid_demand_increase").alias("alert_type"), F.lit("warning").alias("severity"), F.col("recent_trend").alias("value"))),
    )
    return risk.select(*keys, F.explode(F.array_compact(rules)).alias("w")).select(*keys, "w.*")


def allocate_across_stores(daily: DataFrame, item: str, min_rows: int = 10) -> DataFrame:
    """Share of each item per store, raised by risk and normalised to 100 per item."""
    m = (
        daily.groupBy("store_id", item)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            mean_of("sale_amount").alias("avg_demand"),
            (share_if(F.col("stock_hours") > 0) + F.coalesce(ratio(std_of("sale_amount"), mean_of("sale_amount")), F.lit(0.0))).alias(
                "risk_score"
            ),
        )
        .filter(F.col("rows") >= min_rows)
    )
    raised = m.withColumn("_w", F.col("avg_demand") * (1 + F.col("risk_score") * 0.2))
    total = raised.groupBy(item).agg(F.sum("_w").alias("_t"))
    return raised.join(total, item).withColumn("allocation_pct", ratio("_w", "_t") * 100).drop("_w", "_t", "rows")


def weighted_risk(daily: DataFrame, keys: Sequence[str], as_of: dt.date) -> DataFrame:
    """Five weighted factors to a 0..100 score, raised 30 % when the last three rows run hot; stock targets for two weeks."""
    ranked = tail_rank(daily, keys).withColumn("_up", F.row_number().over(W.partitionBy(*keys).orderBy("sale_date")))
    amount, stock, r, u = F.col("sale_amount"), F.col("stock_level"), F.col("from_end"), F.col("_up")
    promo, hol = F.col("activity_flag"), F.col("holiday_flag")
    g = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        mean_of(amount).alias("avg_sales"),
        std_of(amount).alias("_std"),
        mean_of(stock).alias("_stock"),
        F.min(stock).alias("_min"),
        mean_if(r <= 7, amount).alias("_new"),
        mean_if(u <= 7, amount).alias("_old"),
        mean_if(r <= 3, amount).alias("_last3"),
        mean_if(promo, amount).alias("_pa"),
        mean_if(~promo, amount).alias("_pr"),
        mean_if(hol, amount).alias("_ha"),
        mean_if(~hol, amount).alias("_hr"),
    )
    one = F.lit(1.0)

    def lift(a, b, k):
        x = ratio(F.col(a) - F.col(b), F.col(b)) * k
        return F.coalesce(F.greatest(F.lit(0.0), F.least(x, one)), F.lit(0.1))

    g = g.withColumns(
        {
            "low_stock": F.coalesce(F.least(F.greatest(F.lit(0.0), ratio(F.col("_stock") - F.col("_min"), "_stock")), one), F.lit(0.5)),
            "demand_variance": F.coalesce(F.least(ratio("_std", "avg_sales") / 2, one), F.lit(0.2)),
            "demand_trend": F.when(
                F.col("rows") >= 7,
                F.coalesce(F.least(F.greatest(F.lit(0.0), ratio(F.col("_new") - F.col("_old"), "_old")) * 0.5, one), F.lit(0.1)),
            ).otherwise(0.1),
            "promotion_impact": lift("_pa", "_pr", 0.3),
            "seasonal": lift("_ha", "_hr", 0.2),
        }
    )
    score = F.least(
        (
            F.col("low_stock") * 0.3
            + F.col("demand_variance") * 0.25
            + F.col("demand_trend") * 0.2
            + F.col("promotion_impact") * 0.15
            + F.col("seasonal") * 0.1
        )
        * 100,
        F.lit(100.0),
    )
    hot = (F.col("rows") >= 3) & (F.col("_last3") > F.col("avg_sales") * 1.2)
    g = g.withColumn("_s", score).withColumn("risk_score", F.when(hot, F.least(F.col("_s") * 1.3, F.lit(100.0))).otherwise(F.col("_s")))
    target = whole(F.col("avg_sales") * 7 * (1 + F.col("risk_score") / 100))
    cols = {"min_stock": whole(F.col("avg_sales") * 3)}
    for label, ahead in (("week_1", 1), ("week_2", 8)):
        weekend = (as_of + dt.timedelta(days=ahead)).weekday() >= 5
        cols[f"target_{label}"] = whole(target * 1.2) if weekend else target
        cols[f"max_{label}"] = whole(whole(target * 1.5) * 1.2) if weekend else whole(target * 1.5)
    return g.withColumns(cols).drop("_std", "_stock", "_min", "_new", "_old", "_last3", "_pa", "_pr", "_ha", "_hr", "_s")


def demand_position(
    sales: DataFrame, store: DataFrame, as_of: dt.date, bucket: Column | None = None, unit_price: float = 5.0, keys: DataFrame | None = None
) -> DataFrame:
    """Stock estimate, stock-out frequency, unconstrained daily demand and reorder advice for every key at once.

    One aggregation holds the 30, 60 and 90 day metrics of the (store, product) that sold in that time; the others fall back
    to formulae of their ids.  ``keys`` are all distinct (store_id, product_id), those of ``sales`` where none are given; with
    them ``sales`` needs the last 90 days only.  ``bucket`` is the 0..99 location variation.
    """
    bucket = stable_bucket("city_id", "store_id") if bucket is None else bucket
    d, h, amount = F.col("sale_date"), F.col("stock_hour6_22_cnt"), F.col("sale_amount")
    since = lambda n: d >= F.lit(as_of - dt.timedelta(days=n))
    d30, d60, d90 = since(30), since(60) & (amount > 0), since(90)
    keys = sales.select("store_id", "product_id").distinct() if keys is None else keys
    recent = sales.filter(d90).groupBy("store_id", "product_id").agg(
        F.count_if(d30).alias("n30"),
        mean_if(d30, amount).alias("a30"),
        mean_if(d30, h).alias("h30"),
        ratio(F.count_if(d30 & (h == 0)), F.count_if(d30)).alias("avail30"),
        F.max_by(h, d).alias("recent_hours"),
        F.count_if(d90).alias("n90"),
        ratio(F.count_if(d90 & (h > 0)), F.count_if(d90)).alias("freq90"),
        mean_if(d90, h).alias("h90"),
        F.count_if(d90 & (h > 8)).alias("severe90"),
        F.max(F.when(d90 & (h > 0), d)).alias("last_stockout"),
        F.count_if(d60).alias("n60"),
        mean_if(d60, amount).alias("a60"),
        mean_if(d60, h).alias("h60"),
        mean_if(d60 & (h == 0), amount).alias("a60_stocked"),
        mean_if(d60 & (h > 0), amount).alias("a60_out"),
    )
    g = keys.join(recent, ["store_id", "product_id"], "left").join(store.select("store_id", "city_id"), "store_id").withColumn("_b", bucket / F.lit(100.0))
    pid, b = F.col("product_id"), F.col("_b")
    part = lambda n: (pid % n) / F.lit(float(n))

    # stock estimate from 30 days
    daily = F.greatest(F.lit(1.0), F.col("a30") / unit_price)
    base = whole(daily * (7 + F.col("avail30") * 14))
    eased = (
        F.when(F.col("recent_hours") > 12, F.greatest(whole(daily * 2), base - whole(daily * 3)))
        .when(F.col("recent_hours") > 6, F.greatest(whole(daily * 3), base - whole(daily * 2)))
        .otherwise(base)
    )
    varied = whole(eased * (1 + F.col("h30") / 16 * 0.3) * (part(100) * 0.4 + 0.8) * (b * 0.3 + 0.85))
    idle = whole(
        (30 + pid % 40) * ((F.col("city_id") % 10) * 0.1 + 0.9) * ((F.col("store_id") % 15) * 0.05 + 0.95)
    )
    stock = F.when(F.col("n30") > 0, F.greatest(whole(daily), varied)).otherwise(F.greatest(F.lit(15).cast("bigint"), idle))

    # stock-out frequency from 90 days
    severity = F.when(F.col("h90") > 8, 1.3).when(F.col("h90") > 4, 1.1).otherwise(1.0)
    adjusted = F.col("freq90") + F.when(F.col("severe90") > 0, F.col("severe90") / F.col("n90") * 0.5).otherwise(0.0)
    frequency = F.least(
        F.lit(1.0),
        F.when(F.col("n90") > 0, adjusted * severity * (part(20) * 0.3 + 0.85) * (b * 0.2 + 0.9)).otherwise(
            0.05 * (part(15) * 0.4 + 0.8) * (b * 0.2 + 0.9)
        ),
    )

    # unconstrained demand from 60 days
    known = F.col("a60_stocked") / unit_price
    lifted = F.when(F.col("a60_out") > 0, known * (1 + F.col("h60") / 16 * 0.5)).otherwise(known)
    seen = F.when(F.col("a60_stocked") > 0, lifted).otherwise(F.col("a60") / unit_price)
    demand = F.greatest(
        F.lit(1.0),
        F.when(F.col("n60") > 0, seen * (part(50) * 0.6 + 0.7) * (b * 0.4 + 0.8)).otherwise(
            8.0 * (part(30) * 0.8 + 0.6) * (b * 0.4 + 0.8)
        ),
    )
    out = g.select(
        "city_id", "store_id", "product_id", "last_stockout",
        stock.alias("current_stock"), frequency.alias("stockout_frequency"), demand.alias("avg_daily_demand"),
    )
    s, f, q = F.col("current_stock"), F.col("stockout_frequency"), F.col("avg_daily_demand")
    days_risk = ladder(s / F.greatest(q, F.lit(1.0)), [(1, 0.9), (3, 0.7), (7, 0.5), (14, 0.3)], 0.1, op="<=")
    return out.withColumns(
        {
            "risk_score": clamp(days_risk * 0.7 + F.least(f * 2, F.lit(1.0)) * 0.3, 0, 1),
            "days_until_stockout": whole(s / q),
            "reorder_quantity": F.greatest(F.lit(50).cast("bigint"), whole(q * 30) + whole(q * 7 * (1 + f))),
        }
    )


def demand_insights(position: DataFrame, unit_price: float = 5.0) -> DataFrame:
    """Urgency, month demand and week loss of every key."""
    return position.select(
        "city_id",
        "store_id",
        "product_id",
        "risk_score",
        ladder("risk_score", [(0.8, "critical"), (0.6, "high"), (0.4, "medium")], "low").alias("urgency"),
        (F.col("avg_daily_demand") * 30).alias("month_demand"),
        (F.col("avg_daily_demand") * 7 * F.col("stockout_frequency") * unit_price).alias("estimated_lost_sales"),
    )


def cover_risk(position: DataFrame) -> DataFrame:
    """Risk class of each key by days of cover."""
    cover = F.col("current_stock") / F.greatest(F.col("avg_daily_demand"), F.lit(1.0))
    return position.withColumn("cover_days", cover).withColumn(
        "cover_risk", ladder("cover_days", [(3, 0.9), (7, 0.7), (14, 0.5)], 0.3, op="<=")
    )


def portfolio_risk(position: DataFrame) -> DataFrame:
    """Overall mean risk and number of high-risk keys."""
    return cover_risk(position).agg(
        F.count(F.lit(1)).alias("keys"),
        F.avg("cover_risk").alias("overall_risk"),
        F.count_if(F.col("cover_risk") >= 0.7).alias("high_risk_keys"),
    )


def risk_timeline(position: DataFrame, as_of: dt.date, horizon: int = 30) -> DataFrame:
    """Predicted stock-outs per day within the horizon and the demand at stake."""
    hit = cover_risk(position).filter(F.col("cover_days") <= horizon)
    return hit.groupBy(F.date_add(F.lit(as_of), whole(F.col("cover_days")).cast("int")).alias("stockout_date")).agg(
        F.count(F.lit(1)).alias("keys"), F.sum(F.col("avg_daily_demand") * 50).alias("estimated_impact")
    )


def location_risk(sales: DataFrame) -> DataFrame:
    """Mean stock-out hours and share of severe days per city and store."""
    h = F.col("stock_hour6_22_cnt")
    return sales.groupBy("city_id", "store_id").agg(
        mean_of(h).alias("avg_stockout_hours"), share_if(h > 8).alias("severe_rate"), F.count(F.lit(1)).alias("rows")
    )


def supply_against_lead_time(
    status: DataFrame, base_risk: Column, lead_days: int = 7, service_level: float = 95
) -> DataFrame:
    """Days of supply against the lead time: risk x1.5 below it, x0.7 beyond twice it; safety and reorder units."""
    rate, stock = F.col("avg_daily_sales"), F.col("current_stock")
    supply = F.when(rate > 0, stock / rate).otherwise(F.lit(lead_days * 2.0))
    safety = rate * lead_days * (service_level / 100)
    out = status.withColumns({"days_of_supply": supply, "_b": base_risk, "safety_units": safety})
    risk = (
        F.when(F.col("days_of_supply") < lead_days, F.least(F.lit(100.0), F.col("_b") * 1.5))
        .when(F.col("days_of_supply") < lead_days * 2, F.col("_b"))
        .otherwise(F.greatest(F.lit(10.0), F.col("_b") * 0.7))
    )
    out = out.withColumn("risk", risk)
    return out.withColumns(
        {
            "risk_class": ladder("risk", [(80, "Critical"), (60, "High"), (40, "Medium")], "Low", op=">"),
            "reorder_units": whole(rate * lead_days + F.col("safety_units")),
        }
    ).drop("_b")


def allocate_forecast(forecast: DataFrame, item: str, service_level: float = 0.95, holding: float = 0.02) -> DataFrame:
    """Stock per item from forecast bounds: safety, recommended stock, turnover and holding cost."""
    safety = (F.col("upper") - F.col("forecast")) * service_level
    per = forecast.withColumn("_s", safety).groupBy(item).agg(
        F.sum("forecast").alias("predicted_demand"),
        F.sum("_s").alias("safety_stock"),
    )
    rec = F.col("predicted_demand") + F.col("safety_stock")
    return per.withColumns(
        {"recommended_stock": rec, "turnover": ratio("predicted_demand", rec), "holding_cost": rec * holding}
    )


def stockout_base(sales: DataFrame, events: DataFrame) -> DataFrame:
    """Sales with the day's stock-out duration and lost sales, zero where there was none."""
    per = events.groupBy("store_id", "product_id", "sale_date").agg(
        F.sum("duration_hours").alias("stockout_duration"), F.sum("estimated_lost_sales").alias("lost_sales")
    )
    return sales.join(per, ["store_id", "product_id", "sale_date"], "left").withColumns(
        {
            "stockout_duration": F.coalesce("stockout_duration", F.lit(0)),
            "lost_sales": F.coalesce("lost_sales", F.lit(0.0)),
            "had_stockout": F.col("stock_hour6_22_cnt") > 0,
        }
    )


def transfer_history(stored: DataFrame, as_of: dt.date, days: int = 30, store_id: int | None = None) -> DataFrame:
    """Stored transfers of the last days, of one store as source or target if given, newest and best first."""
    rows = stored.filter(F.col("analysis_date") >= F.lit(as_of - dt.timedelta(days=days)))
    if store_id is not None:
        rows = rows.filter((F.col("source_store_id") == store_id) | (F.col("target_store_id") == store_id))
    return rows.orderBy(F.desc("analysis_date"), F.desc("optimization_score"), "source_store_id", "target_store_id", "product_id")


def optimisation_opportunities(
    stored: DataFrame, product: DataFrame, city: DataFrame, as_of: dt.date, days: int = 7, min_score: float = 70.0, min_success: float = 80.0
) -> DataFrame:
    """Stored transfers of the last days that score well and are likely to succeed, with names, largest revenue first."""
    good = stored.filter(
        (F.col("analysis_date") >= F.lit(as_of - dt.timedelta(days=days))) & (F.col("optimization_score") >= min_score) & (F.col("success_probability") >= min_success)
    )
    named = good.join(product.select("product_id", "product_name"), "product_id").join(city.select("city_id", "city_name"), "city_id")
    return named.orderBy(F.desc("revenue_impact"), F.desc("optimization_score"), "source_store_id", "target_store_id", "product_id")
