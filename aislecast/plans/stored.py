"""Queries over what jobs write: versions, refreshed views, payload tables, stored transfers; rule tables and strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import mean_if
from ..operators import inventory as inv
from ..operators import promotions as prm
from ..operators import stores
from ..operators import weather as wea
from ..sources import sinks, versioned
from ..sources.paging import PageIndex
from ..sources.views import View
from ..streaming.monitors import run_folder
from . import correlation as correlation_plans
from . import inventory as inventory_plans
from . import market as market_plans
from . import reports as report_plans
from .features import MEAN
from .registry import q, query

# ---- written tables ----------------------------------------------------------------------------------


@query(
    "upserted_versions",
    "SRC-15",
    f"""
, o AS (SELECT store_id, sale_date, sum(sale_amount) a FROM lines WHERE sale_date<=(SELECT d FROM ref)-30 GROUP BY 1,2), n AS (SELECT store_id, sale_date, sum(sale_amount)*2 a FROM lines WHERE sale_date>=(SELECT d FROM ref)-90 GROUP BY 1,2)
SELECT store_id, sale_date::VARCHAR AS sale_date, {q('a')} AS total_sales FROM n UNION ALL
SELECT store_id, sale_date::VARCHAR, {q('a')} FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.store_id=o.store_id AND n.sale_date=o.sale_date)""",
)
def upserted_versions(t):
    """A first version written, an upsert that writes the touched buckets again, and the second version read back."""
    path, keys = f"{run_folder(t.spark)}/store_metrics", ["store_id", "sale_date"]
    versioned.create(stores.daily_store_metrics(t.lines(until=t.day(30))).select(*keys, "total_sales"), path, keys)
    new = stores.daily_store_metrics(t.lines(since=t.day(90))).select(*keys, (F.col("total_sales") * 2).cast("decimal(24,2)").alias("total_sales"))
    versioned.upsert(new, path)
    return versioned.read(t.spark, path)


@query(
    "refreshed_daily_view",
    "SRC-18",
    f"""
SELECT sale_date::VARCHAR AS sale_date, store_id, product_id, {q('sum(sale_amount)')} AS total_amount, sum(units_sold)::BIGINT * CASE WHEN sale_date>=(SELECT d FROM ref)-30 THEN 2 ELSE 1 END AS total_units, count(*) AS transactions
FROM sales WHERE sale_date>=(SELECT d FROM ref)-120 GROUP BY 1,2,3, sales.sale_date""",
)
def refreshed_daily_view(t):
    """The view of the last days, then the newest days changed: their rows withdrawn and added again with twice the units."""
    keys = ["sale_date", "store_id", "product_id"]
    view = View(f"{run_folder(t.spark)}/daily_view", keys, "trunc(sale_date, 'week')", {"total_amount": "sale_amount", "total_units": "units_sold"})
    view.create(t.lines(since=t.day(120)))
    newest = t.lines(since=t.day(30))
    again = newest.withColumns({"units_sold": (F.col("units_sold") * 2).cast("long"), "sign": F.lit(1)})
    view.apply(again.unionByName(newest.withColumn("sign", F.lit(-1))))
    return view.read(t.spark).select(*keys, "total_amount", "total_units", F.col("rows").alias("transactions"))


@query(
    "incremental_city_view",
    "SRC-18 CMB-14",
    f"""
, r AS (SELECT sale_date, city_id, product_id, units_sold, sale_amount FROM sales WHERE NOT (product_id%7=0 AND sale_date>=(SELECT d FROM ref)-20)
  UNION ALL SELECT sale_date+1, city_id, product_id, units_sold, sale_amount FROM sales WHERE product_id%7=0 AND sale_date>=(SELECT d FROM ref)-20)
SELECT sale_date::VARCHAR AS sale_date, city_id, count(*) AS "rows", {q('sum(sale_amount)')} AS amount, sum(units_sold)::BIGINT AS units, count(DISTINCT product_id) AS distinct_product_id FROM r GROUP BY r.sale_date, city_id""",
)
def incremental_city_view(t):
    """Sums and distinct products by day and city; some sales of the newest days are withdrawn and come back a day later."""
    sales = t.sales(category=False).select("sale_date", "city_id", "product_id", "units_sold", "sale_amount")
    view = View(f"{run_folder(t.spark)}/city_view", ["sale_date", "city_id"], "trunc(sale_date, 'quarter')", {"amount": "sale_amount", "units": "units_sold"}, "product_id")
    view.create(sales)
    moved = sales.filter((F.col("product_id") % 7 == 0) & (F.col("sale_date") >= F.lit(t.day(20))))
    later = moved.withColumns({"sale_date": F.date_add("sale_date", 1), "sign": F.lit(1)})
    view.apply(moved.withColumn("sign", F.lit(-1)).unionByName(later))
    return view.read(t.spark)


@query(
    "indexed_sales_page",
    "SRC-10 FLT-8",
    f"""
SELECT sale_date::VARCHAR AS sale_date, store_id, product_id, units_sold, {q('sale_amount')} AS sale_amount FROM lines l ORDER BY l.sale_date, store_id, product_id LIMIT 50 OFFSET 5000""",
)
def indexed_sales_page(t):
    """Page 100 of all sales through the key-range index: the fences name the range, which alone is read."""
    index = PageIndex(f"{run_folder(t.spark)}/sales_pages", ["sale_date", "store_id", "product_id"])
    index.build(t.lines().select("sale_date", "store_id", "product_id", "units_sold", "sale_amount"))
    return index.page(t.spark, 100, 50)


_PAYLOADS = (
    report_plans._nested("sa", inventory_plans._TRANSFER, "SELECT 'transfer' AS kind, count(*) AS n, sum(rev)::DOUBLE AS v FROM transfers")
    + report_plans._nested("sb", correlation_plans._PERF, "SELECT 'portfolio' AS kind, count(*) AS n, sum(tr)::DOUBLE AS v FROM pq")
    + report_plans._nested("sc", market_plans._SEG, "SELECT 'behaviour' AS kind, count(*) AS n, sum(lv)::DOUBLE AS v FROM nm")
    + report_plans._nested("sd", market_plans._THR, "SELECT 'competition' AS kind, count(*) AS n, sum(r)::DOUBLE AS v FROM tv")
)


@query(
    "stored_payloads",
    "SRC-17",
    f"""{report_plans._INS}{_PAYLOADS}
, al AS (SELECT * FROM sa UNION ALL SELECT * FROM sb UNION ALL SELECT * FROM sc UNION ALL SELECT * FROM sd UNION ALL SELECT 'insight', count(*), sum(impact)::DOUBLE FROM fused)
SELECT kind, n AS "rows", {q('v', 1)} AS total FROM al WHERE n>0""",
    digits=1,
)
def stored_payloads(t):
    """Results of five kinds appended with their payloads to one table, and summed from the payloads read back."""
    path = f"{run_folder(t.spark)}/results"
    parts = {
        "transfer": (inv.transfer_opportunities(inventory_plans._status(t)), ["source_store_id", "target_store_id", "product_id"], "revenue_impact"),
        "portfolio": (correlation_plans.product_performance(t), ["product_id"], "total_revenue"),
        "behaviour": (market_plans._coded(t), ["name"], "lifetime_value"),
        "competition": (market_plans._threats(t), ["first_category"], "revenue"),
        "insight": (report_plans._insights(t), ["insight_type", "category", "subject"], "impact"),
    }
    for kind, (rows, keys, _) in parts.items():
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        sinks.append_results(rows.withColumns({"kind": F.lit(kind), "key": key}), path, ["kind", "key"])
    value = F.coalesce(*[F.when(F.col("kind") == k, F.get_json_object("payload", f"$.{v}").cast("double")) for k, (_, _, v) in parts.items()])
    return t.spark.read.parquet(path).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))


# ---- stored transfers: analysis day and success are formulae of the product, as nothing stores them here -----------------

_LOG = f"""{inventory_plans._TRANSFER}
, lg AS (SELECT *, (SELECT d FROM ref)-(product_id%60)::INT AS ad, 70+(product_id*7%30)::DOUBLE AS sp FROM transfers)"""


def _log(t):
    path = f"{run_folder(t.spark)}/transfers"
    day = F.date_sub(F.lit(t.as_of), (F.col("product_id") % 60).cast("int"))
    rows = inv.transfer_opportunities(inventory_plans._status(t))
    rows.withColumns({"analysis_date": day, "success_probability": (70 + F.col("product_id") * 7 % 30).cast("double")}).write.parquet(path)
    return t.spark.read.parquet(path)


@query(
    "transfer_history",
    "INV-9",
    f"""{_LOG}
SELECT src AS source_store_id, tgt AS target_store_id, product_id, trunc(qty)::BIGINT AS quantity, {q('score')} AS optimization_score, {q('rev')} AS revenue_impact, prio AS priority, ad::VARCHAR AS analysis_date
FROM lg WHERE ad>=(SELECT d FROM ref)-30 AND (src=3 OR tgt=3)""",
)
def transfer_history(t):
    rows = inv.transfer_history(_log(t), t.as_of, store_id=3)
    return rows.select("source_store_id", "target_store_id", "product_id", "quantity", "optimization_score", "revenue_impact", "priority", "analysis_date")


@query(
    "optimisation_opportunities",
    "INV-10",
    f"""{_LOG}
SELECT lg.city_id, city_name, lg.product_id, product_name, {q('score')} AS optimization_score, {q('rev')} AS revenue_impact, prio AS priority, sp AS success_probability
FROM lg JOIN product p ON p.product_id=lg.product_id JOIN city c ON c.city_id=lg.city_id WHERE ad>=(SELECT d FROM ref)-7 AND score>=70 AND sp>=80""",
)
def optimisation_opportunities(t):
    rows = inv.optimisation_opportunities(_log(t), t.product, t.city, t.as_of)
    return rows.select("city_id", "city_name", "product_id", "product_name", "optimization_score", "revenue_impact", "priority", "success_probability")


# ---- rule tables and strategies ------------------------------------------------------------------------

_NOW = """
, nw AS (SELECT city_id, avg_temperature t, precpt p, avg_humidity h FROM weather w WHERE date=(SELECT max(date) FROM weather w2 WHERE w2.city_id=w.city_id))"""


def _now(t):
    value = lambda c: F.max_by(c, "date")
    g = t.weather.groupBy("city_id").agg(value("avg_temperature").alias("temperature"), value("precpt").alias("precipitation"), value("avg_humidity").alias("humidity"))
    kind = F.when(F.col("precipitation") > 5, "rainy").when(F.col("temperature") < 18, "cold").when(F.col("temperature") > 25, "warm").otherwise("mild")
    return g.withColumn("weather_category", kind)


@query(
    "weather_rule_advice",
    "WEA-11 CMB-5",
    f"""{_NOW}
, ru(place, rule, products, val, above, bound, impact, adjust) AS (VALUES (0,'cold_weather_boost',[306,413,109],'t',FALSE,20,15,20), (1,'rainy_weather_boost',[306,413],'p',TRUE,4,20,25),
  (2,'warm_weather_boost',[118,368],'t',TRUE,24,12,15), (3,'high_humidity_boost',[306,413],'h',TRUE,80,18,22)),
ea AS (SELECT city_id, ru.*, unnest(products) AS product_id, CASE val WHEN 't' THEN t WHEN 'p' THEN p ELSE h END AS seen FROM nw, ru),
fi AS (SELECT *, row_number() OVER (PARTITION BY city_id, product_id ORDER BY place) AS rn FROM ea WHERE CASE WHEN above THEN seen>bound ELSE seen<bound END)
SELECT city_id, product_id::BIGINT AS product_id, rule, impact::DOUBLE AS impact_pct, adjust::INT AS stock_adjustment FROM fi WHERE rn=1""",
)
def weather_rule_advice(t):
    return wea.rule_advice(_now(t))


_CLASS = f"""{_NOW}
, wc AS (SELECT city_id, CASE WHEN p>5 THEN 'rainy' WHEN t<18 THEN 'cold' WHEN t>25 THEN 'warm' ELSE 'mild' END AS wc FROM nw)"""


@query(
    "weather_bundle_advice",
    "WEA-11",
    f"""{_CLASS}
, bu(bundle, w, products) AS (VALUES ('cold_weather_bundle','cold',[306,413,109]), ('rainy_day_bundle','rainy',[306,413]), ('warm_weather_bundle','warm',[118,368])),
ea AS (SELECT city_id, bundle, unnest(products) AS product_id FROM wc JOIN bu ON bu.w=wc.wc)
SELECT city_id, bundle, 0.15::DOUBLE AS discount, 0.25::DOUBLE AS expected_boost, count(*) AS products FROM ea WHERE EXISTS (SELECT 1 FROM sales s WHERE s.city_id=ea.city_id AND s.product_id=ea.product_id) GROUP BY 1,2 HAVING count(*)>=2""",
)
def weather_bundle_advice(t):
    return wea.bundle_advice(_now(t), t.sales(category=False))


@query(
    "weather_season_advice",
    "WEA-11",
    f"""{_CLASS}
SELECT city_id, CASE wc WHEN 'cold' THEN 'winter' WHEN 'warm' THEN 'summer' ELSE 'rainy' END AS season, CASE wc WHEN 'cold' THEN 10 WHEN 'warm' THEN 15 ELSE 12 END AS impact_from,
  CASE wc WHEN 'cold' THEN 20 WHEN 'warm' THEN 25 ELSE 18 END AS impact_to FROM wc WHERE wc<>'mild'""",
)
def weather_season_advice(t):
    return wea.season_advice(_now(t))


@query(
    "promotion_strategies",
    "PRM-5",
    f"""
, g AS (SELECT store_id, {MEAN('sale_amount', 'activity_flag')} pf, {MEAN('sale_amount', 'NOT activity_flag')} rf FROM sales GROUP BY 1),
b AS (SELECT store_id, arg_max(discount, m) bd FROM (SELECT store_id, discount, {MEAN('sale_amount')} m FROM sales WHERE activity_flag GROUP BY 1,2) GROUP BY 1),
e AS (SELECT store_id, (pf-rf)/rf*100 u, rf bs, CASE WHEN bd*100>60 THEN 25::DOUBLE WHEN bd*100<5 THEN 15 ELSE (bd*100)::DOUBLE END bd FROM g JOIN b USING (store_id)),
x AS (SELECT *, least(bd*1.3, 35) st, greatest(bd*0.7, 10) so, CASE WHEN u<0 THEN 'conservative' WHEN u>50 THEN 'balanced' ELSE 'data_driven' END k FROM e, range(1,4) r(n)),
y AS (SELECT store_id, k, n, bs, u,
  CASE k WHEN 'conservative' THEN [5.0,10,15][n] WHEN 'balanced' THEN [12.0,20,30][n] ELSE [least(bd,25),st,so][n] END::DOUBLE d,
  CASE k WHEN 'conservative' THEN [3,5,7][n] WHEN 'balanced' THEN [7,6,5][n] ELSE [7,10,5][n] END dd,
  CASE k WHEN 'data_driven' THEN [bd,st,so][n] END::DOUBLE by_, [0.8,1.1,0.6][n]::DOUBLE kk FROM x),
z AS (SELECT *, CASE k WHEN 'conservative' THEN [2.0,5,8][n] WHEN 'balanced' THEN d*1.5 ELSE greatest([5.0,8,3][n]::DOUBLE, u*kk) END::DOUBLE up FROM y)
SELECT store_id, k AS strategy, n::INT AS option, {q('d')} AS discount, dd::INT AS duration_days, {q('up')} AS estimated_uplift,
  (CASE k WHEN 'conservative' THEN greatest(n, floor(bs*(up/100)*dd)) WHEN 'balanced' THEN greatest(2, floor(bs*(d*0.015::DOUBLE)*dd)) ELSE greatest([3,5,2][n], floor(bs*(u*kk/100))) END)::BIGINT AS incremental_sales,
  {q('CASE k WHEN \'conservative\' THEN [0.40,0.50,0.53][n]::DOUBLE WHEN \'balanced\' THEN (1+d*0.015::DOUBLE)/(d/100) ELSE greatest([0.5,0.6,0.4][n]::DOUBLE, (u*kk/100)/(by_/100)) END')} AS estimated_roi FROM z""",
)
def promotion_strategies(t):
    s = t.sales(geo=False, category=False)
    base = s.groupBy("store_id").agg(mean_if(~F.col("activity_flag"), "sale_amount").alias("baseline_sales"))
    return prm.promotion_strategies(prm.effectiveness(s, ["store_id"]), base, ["store_id"])
