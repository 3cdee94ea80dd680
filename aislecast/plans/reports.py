"""Ingest, sink, check, insight and composite report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as alert_ops
from ..operators import categories as cat
from ..operators import insights as ins
from ..operators import inventory as inv
from ..operators import stores
from ..operators.features import aggregate_category
from ..sources import checks, ingest, sinks
from ..streaming.monitors import run_folder
from . import alerts as alert_plans
from . import correlation as correlation_plans
from . import forecast as forecast_plans
from . import inventory as inventory_plans
from . import market as market_plans
from .features import MEAN
from .registry import q, query


@query(
    "csv_round_trip",
    "SRC-9 SRC-11",
    f"""
SELECT city_id, store_id, product_id, sale_date::VARCHAR AS dt, {q('sale_amount')} AS sale_amount, stock_hour6_22_cnt, {q('discount')} AS discount, holiday_flag::INT AS holiday_flag, activity_flag::INT AS activity_flag,
  {q('precpt')} AS precpt, {q('avg_temperature')} AS avg_temperature, management_group_id FROM sales""",
)
def csv_round_trip(t):
    """Sales exported as CSV chunks in the shared folder and read back with the typed reader."""
    s = t.sales().select(
        "city_id", "store_id", "management_group_id",
        F.lit(0).alias("first_category_id"), F.lit(0).alias("second_category_id"), F.col("third_category").alias("third_category_id"),
        "product_id", F.col("sale_date").alias("dt"), "sale_amount", "stock_hour6_22_cnt", "discount",
        F.col("holiday_flag").cast("int").alias("holiday_flag"), F.col("activity_flag").cast("int").alias("activity_flag"),
        "precpt", "avg_temperature", "avg_humidity", "avg_wind_level",
    )
    path = f"{run_folder(t.spark)}/csv"
    sinks.export(s, path, "csv")
    back = ingest.read_daily_sales(t.spark, path)
    return back.select(
        "city_id", F.col("store_id").cast("bigint").alias("store_id"), F.col("product_id").cast("bigint").alias("product_id"), "dt", "sale_amount",
        "stock_hour6_22_cnt", "discount", "holiday_flag", "activity_flag", "precpt", "avg_temperature", "management_group_id",
    )


@query(
    "normalised_sales",
    "SRC-12 FN-24",
    f"""
, dx AS (SELECT sale_date, (DATE '2022-01-01' + (dense_rank() OVER (ORDER BY sale_date)-1)::INT) AS dt FROM sale_days),
hx AS (SELECT date, (row_number() OVER (ORDER BY date)-1)%10 k FROM holidays),
hs AS (SELECT sale_date, store_id, product_id, '[' || string_agg(hour_sale::DECIMAL(4,1)::VARCHAR, ',' ORDER BY hour_of_day) || ']' js FROM hourly GROUP BY 1,2,3)
SELECT dx.dt::VARCHAR AS dt, s.store_id, store_name, s.product_id, product_name, c.city_name, {q('sale_amount')} AS sale_amount, js AS hours_sale, activity_flag::INT AS activity_flag,
  ['New Year','Spring Festival','Lantern Festival','Tomb Sweeping Day','Labour Day','Dragon Boat Festival','Mid-Autumn Festival','National Day','Double Ninth Festival','Winter Solstice'][k+1] AS holiday_name
FROM sales s JOIN dx ON dx.sale_date=s.sale_date LEFT JOIN hx ON hx.date=s.sale_date JOIN hs ON hs.sale_date=s.sale_date AND hs.store_id=s.store_id AND hs.product_id=s.product_id
LEFT JOIN city c ON c.city_id=s.city_id LEFT JOIN store st ON st.store_id=s.store_id LEFT JOIN product p ON p.product_id=s.product_id""",
)
def normalised_sales(t):
    n = ingest.normalise(t.with_hours(t.sales()), t.city, t.store, t.product)
    return n.select(
        "dt", "store_id", "store_name", "product_id", "product_name", "city_name", "sale_amount", "hours_sale", "activity_flag", "holiday_name"
    )


@query(
    "subset_extraction",
    "SRC-14 JN-5",
    f"""
, c AS (SELECT DISTINCT city_id FROM sales ORDER BY 1 LIMIT 10), s1 AS (SELECT * FROM sales WHERE city_id IN (SELECT city_id FROM c)),
st AS (SELECT DISTINCT store_id FROM s1 ORDER BY 1 LIMIT 20), s2 AS (SELECT * FROM s1 WHERE store_id IN (SELECT store_id FROM st)),
p AS (SELECT DISTINCT product_id FROM s2 ORDER BY 1 LIMIT 1000)
SELECT city_id, store_id, product_id, sale_date::VARCHAR AS sale_date, {q('sale_amount')} AS sale_amount FROM s2 WHERE product_id IN (SELECT product_id FROM p)""",
)
def subset_extraction(t):
    sub = ingest.extract_subset(t.sales(), 10, 20, 1000)
    return sub["sales"].select("city_id", "store_id", "product_id", "sale_date", "sale_amount")


@query(
    "derived_tables",
    "CMB-14 SRC-13",
    """
SELECT 'city' AS tbl, count(DISTINCT city_id) AS n FROM sales UNION ALL SELECT 'store', count(DISTINCT store_id) FROM sales UNION ALL SELECT 'product', count(DISTINCT product_id) FROM sales
UNION ALL SELECT 'weather', count(DISTINCT (city_id, sale_date)) FROM sales UNION ALL SELECT 'holidays', count(DISTINCT sale_date) FROM sales WHERE holiday_flag
UNION ALL SELECT 'promotions', count(*) FROM sales WHERE activity_flag""",
)
def derived_tables(t):
    out = None
    for name, df in ingest.derive_tables(t.sales()).items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "upserted_metrics",
    "SRC-15 JN-6",
    f"""
, o AS (SELECT store_id, sale_date, sum(sale_amount) a FROM lines WHERE sale_date<=(SELECT d FROM ref)-30 GROUP BY 1,2), n AS (SELECT store_id, sale_date, sum(sale_amount)*2 a FROM lines WHERE sale_date>=(SELECT d FROM ref)-90 GROUP BY 1,2)
SELECT store_id, sale_date::VARCHAR AS sale_date, {q('a')} AS total_sales FROM n UNION ALL
SELECT store_id, sale_date::VARCHAR, {q('a')} FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.store_id=o.store_id AND n.sale_date=o.sale_date)""",
)
def upserted_metrics(t):
    cols = ["store_id", "sale_date", "total_sales"]
    old = stores.daily_store_metrics(t.lines(until=t.day(30))).select(*cols)
    new = stores.daily_store_metrics(t.lines(since=t.day(90))).select("store_id", "sale_date", (F.col("total_sales") * 2).alias("total_sales"))
    return sinks.upsert(old, new, ["store_id", "sale_date"])


@query(
    "constraint_violations",
    "SRC-16",
    """
, v AS (SELECT 'duplicate sale' AS rule, l_shipdate::DATE || '|' || l_suppkey || '|' || l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 2 HAVING count(*)>1
  UNION ALL SELECT 'orders without lines', o_orderkey::VARCHAR, count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 2
  UNION ALL SELECT 'discount range', l_discount::VARCHAR, count(*) FROM lineitem WHERE l_discount>0.08 GROUP BY 2)
SELECT rule, key, n AS "rows" FROM v""",
)
def constraint_violations(t):
    li = t.raw("lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    return checks.validate(
        [
            checks.duplicate_keys(li, ["day", "l_suppkey", "l_partkey"], "duplicate sale"),
            checks.missing_reference(t.raw("orders"), "o_orderkey", li.select("l_orderkey").distinct(), "l_orderkey", "orders without lines"),
            checks.out_of_range(li, "l_discount", 0.0, 0.08, "discount range"),
        ]
    )


@query(
    "stored_alert_payloads",
    "SRC-17 FN-24",
    f"""{alert_plans._LOW}
SELECT alert_type, store_id, item, severity, {q('impact_score')} AS impact_score FROM a1""",
)
def stored_alert_payloads(t):
    """Alerts appended with a JSON payload to a table in the shared folder and read back from it."""
    path = f"{run_folder(t.spark)}/alerts"
    sinks.append_results(alert_plans._low(t), path, ["alert_type", "store_id", "item"])
    back = t.spark.read.parquet(path)
    p = F.from_json("payload", "severity string, impact_score double")
    return back.select("alert_type", "store_id", "item", p.alias("p")).select("alert_type", "store_id", "item", "p.severity", "p.impact_score")


@query(
    "forecast_files",
    "SRC-19",
    f"""{forecast_plans._NAIVE}
SELECT city_id, first_category, dt::VARCHAR AS date, {q('f')} AS forecast, {q('lo')} AS lower, {q('hi')} AS upper FROM naive""",
)
def forecast_files(t):
    """Forecasts written as JSON lines by city and read back with the folder as a column."""
    path = f"{run_folder(t.spark)}/forecast"
    sinks.write_forecasts(forecast_plans._naive(t), path)
    return t.spark.read.schema("city_id int, first_category string, date date, forecast double, lower double, upper double").json(path)


# ---- insights ----------------------------------------------------------------------------------


def _insights(t):
    return ins.fuse(
        [
            ins.from_alerts(alert_ops.merge_alerts(alert_plans._monitors(t), top=None)),
            ins.from_transfers(inv.transfer_opportunities(inventory_plans._status(t))),
            ins.from_bundles(correlation_plans._bundles(t)),
            ins.from_segments(market_plans._coded(t)),
            ins.from_threats(market_plans._threats(t)),
        ]
    )


def _nested(name, ctes, select):
    """One source as a CTE with its own inner WITH list."""
    return f", {name} AS (WITH {ctes.strip().lstrip(',')} {select})"


_INS = (
    _nested(
        "fa", alert_plans._MERGED,
        "SELECT 'alert' insight_type, 'operations' category, concat_ws(':', store_id::VARCHAR, item) subject, severity priority, "
        "85::DOUBLE confidence, revenue_impact::DOUBLE impact FROM m WHERE rn=1",
    )
    + _nested(
        "ft", inventory_plans._TRANSFER,
        "SELECT 'transfer', 'inventory', src || '>' || tgt || '>' || product_id, "
        "CASE prio WHEN 'immediate' THEN 'critical' ELSE prio END, score, rev FROM transfers",
    )
    + _nested(
        "fb", correlation_plans._BUNDLES,
        "SELECT 'bundle', 'portfolio', item_a || '+' || item_b, CASE WHEN r>=0.7 THEN 'high' ELSE 'medium' END, sp*100, rp FROM b",
    )
    + _nested(
        "fs", market_plans._SEG,
        "SELECT 'segment', 'customers', nam, CASE WHEN ch>=0.5 THEN 'high' WHEN ch>=0.25 THEN 'medium' ELSE 'low' END, 75, lv::DOUBLE*0.1 FROM nm",
    )
    + _nested("fh", market_plans._THR, "SELECT 'threat', 'competition', first_category, sev, 70, r*abs(ch) FROM tv")
    + """, fused AS (SELECT * FROM fa UNION ALL SELECT * FROM ft UNION ALL SELECT * FROM fb UNION ALL SELECT * FROM fs UNION ALL SELECT * FROM fh)"""
)


@query(
    "fused_insights",
    "INS-1 CMB-4",
    f"""{_INS}
SELECT insight_type, category, subject, priority, {q('confidence')} AS confidence, {q('impact')} AS impact FROM fused""",
)
def fused_insights(t):
    return _insights(t)


@query(
    "health_score",
    "INS-2",
    f"""{_INS}
, k AS (SELECT insight_type, avg(confidence) c FROM fused GROUP BY 1),
m AS (SELECT coalesce(max(c) FILTER (WHERE insight_type='alert'),70) a, coalesce(max(c) FILTER (WHERE insight_type='transfer'),70) t, coalesce(max(c) FILTER (WHERE insight_type='bundle'),70) b, coalesce(max(c) FILTER (WHERE insight_type='segment'),70) s, coalesce(max(c) FILTER (WHERE insight_type='threat'),70) h FROM k),
o AS (SELECT *, (a+t+b+s+h)/5 ov FROM m)
SELECT {q('a')} AS alert_score, {q('t')} AS transfer_score, {q('b')} AS bundle_score, {q('s')} AS segment_score, {q('h')} AS threat_score, {q('ov')} AS overall_score,
  CASE WHEN ov>=80 THEN 'excellent' WHEN ov>=70 THEN 'good' WHEN ov>=60 THEN 'fair' ELSE 'poor' END AS status, (SELECT count(*) FROM fused WHERE priority='critical') AS critical_count, (SELECT count(*) FROM fused WHERE priority='high') AS high_count FROM o""",
)
def health_score(t):
    return ins.health_score(_insights(t))


@query(
    "executive_summary",
    "CMB-11",
    f"""{_INS}
, w AS (SELECT *, CASE priority WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END wt FROM fused)
SELECT category, count(*) AS insights, count(*) FILTER (WHERE priority IN ('critical','high')) AS pressing, {q('avg(confidence)')} AS avg_confidence, {q('sum(impact)')} AS total_impact, {q('sum(confidence*wt)/sum(wt)')} AS weighted_score FROM w GROUP BY 1""",
)
def executive_summary(t):
    return ins.executive_summary(_insights(t))


@query(
    "custom_insight_report",
    "CMB-11 FLT-1",
    f"""{_INS}
SELECT category, insight_type, priority, count(*) AS insights, {q('sum(impact)')} AS impact FROM fused WHERE impact>=100 AND category IN ('operations','inventory') AND priority IN ('critical','high') GROUP BY 1,2,3""",
)
def custom_insight_report(t):
    return ins.custom_report(_insights(t), ["operations", "inventory"], ["critical", "high"], 100.0)


@query(
    "stored_insight_summary",
    "AGG-22 FN-24",
    f"""
, s AS (SELECT event_type AS category, CASE WHEN user_id%2=0 THEN 'a' ELSE 'b' END insight_type, CASE WHEN value>=50 THEN 'high' ELSE 'low' END priority, event_id%3=0 done, value cf, (props->>'$.k')::DECIMAL(18,2) k FROM events)
SELECT category, insight_type, priority, count(*) AS total_insights, count(*) FILTER (WHERE done) AS completed, {q('avg(cf)')} AS avg_confidence, {q('sum(k)')} AS total_revenue FROM s GROUP BY 1,2,3""",
)
def stored_insight_summary(t):
    # the JSON number of the event rows stands for the stored revenue impact
    ev = t.raw("events")
    stored = ev.select(
        F.col("event_type").alias("category"),
        F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("insight_type"),
        F.when(F.col("value") >= 50, "high").otherwise("low").alias("priority"),
        F.when(F.col("event_id") % 3 == 0, "completed").otherwise("open").alias("status"),
        F.col("value").alias("confidence"),
        F.regexp_replace("props", '"k"', '"revenue_impact"').alias("potential_impact"),
    )
    return ins.stored_summary(stored)


@query(
    "store_advice",
    "CMB-5 FN-14",
    f"""
, m AS (SELECT store_id, stddev_samp(sale_amount::DOUBLE)/{MEAN('sale_amount')} cv, (count(*) FILTER (WHERE stock_hour6_22_cnt>0))::DOUBLE/count(*) so, {MEAN('sale_amount', 'discount>0')}/{MEAN('sale_amount', 'discount=0')} pr FROM lines GROUP BY 1)
SELECT store_id, 'raise_safety_stock' AS rule, 'high' AS priority, {q('cv')} AS value FROM m WHERE cv>0.56
UNION ALL SELECT store_id, 'reduce_stockouts', 'medium', {q('so')} FROM m WHERE so>0.3 UNION ALL SELECT store_id, 'more_promotions', 'low', {q('pr')} FROM m WHERE pr>1.05""",
)
def store_advice(t):
    from ..functions.core import mean_if, mean_of, ratio, share_if, std_of

    d = F.col("discount") > 0
    m = t.lines().groupBy("store_id").agg(
        ratio(std_of("sale_amount"), mean_of("sale_amount")).alias("cv"),
        share_if(F.col("stock_hour6_22_cnt") > 0).alias("so"),
        ratio(mean_if(d, "sale_amount"), mean_if(~d, "sale_amount")).alias("pr"),
    )
    rules = [
        ("raise_safety_stock", "high", F.col("cv") > 0.56, F.col("cv")),
        ("reduce_stockouts", "medium", F.col("so") > 0.3, F.col("so")),
        ("more_promotions", "low", F.col("pr") > 1.05, F.col("pr")),
    ]
    return ins.advice(m, "store_id", rules)


@query(
    "category_report",
    "CMB-7 FEA-6 SRT-2",
    f"""
, cat AS (SELECT sale_date, first_category, store_id, city_id, sum(sale_amount) cs FROM sales GROUP BY 1,2,3,4), p AS (SELECT first_category, sum(cs) ts, count(*) n, {MEAN('cs')} av FROM cat GROUP BY 1),
mo AS (SELECT first_category, month(sale_date) m, {MEAN('sale_amount')} a FROM sales GROUP BY 1,2), g AS (SELECT first_category, arg_max(m,a)::INT pk, arg_min(m,a)::INT lo, (max(a)-min(a))/min(a) st FROM mo GROUP BY 1)
SELECT first_category, {q('ts')} AS total_sales, n AS records, {q('av')} AS avg_sales, pk AS peak_month, lo AS low_month, {q('st')} AS strength FROM p JOIN g USING (first_category)""",
)
def category_report(t):
    s = t.sales()
    from ..functions.core import mean_of

    g = aggregate_category(s).groupBy("first_category").agg(
        F.sum("category_sales").alias("total_sales"), F.count(F.lit(1)).alias("records"), mean_of("category_sales").alias("avg_sales")
    )
    pattern = cat.seasonality_pattern(s).select("first_category", "peak_month", "low_month", "strength")
    return g.join(pattern, "first_category")


@query(
    "promotion_history",
    "CMB-12",
    f"""
, g AS (SELECT store_id, min(sale_date) f, max(sale_date) l, count(*) n, count(DISTINCT sale_date) FILTER (WHERE activity_flag) pd, {MEAN('sale_amount', 'NOT activity_flag')} b, max(sale_amount) FILTER (WHERE activity_flag) pk FROM sales GROUP BY 1)
SELECT store_id, f::VARCHAR AS first_day, l::VARCHAR AS last_day, (l-f)::INT AS span_days, n AS records, pd AS promotion_days, {q('b')} AS baseline, {q('pk')} AS peak_sale FROM g""",
)
def promotion_history(t):
    from ..functions.core import mean_if

    p = F.col("activity_flag")
    return t.sales(geo=False, category=False).groupBy("store_id").agg(
        F.min("sale_date").alias("first_day"),
        F.max("sale_date").alias("last_day"),
        F.date_diff(F.max("sale_date"), F.min("sale_date")).alias("span_days"),
        F.count(F.lit(1)).alias("records"),
        F.count_distinct(F.when(p, F.col("sale_date"))).alias("promotion_days"),
        mean_if(~p, "sale_amount").alias("baseline"),
        F.max(F.when(p, F.col("sale_amount"))).alias("peak_sale"),
    )


