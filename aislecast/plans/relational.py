"""Join and aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import is_weekend
from ..functions.core import mean_of
from ..operators import ranking, relational, summaries
from ..sources import scans
from .features import MEAN
from .registry import q, query


@query(
    "promotion_interval_join",
    "JN-8 PRM-11",
    f"""
, c AS (SELECT l.sale_date, l.store_id, l.product_id, p.promotion_id, p.promotion_type, p.discount_percentage,
    row_number() OVER (PARTITION BY l.sale_date, l.store_id, l.product_id
      ORDER BY p.start_date DESC, p.promotion_id DESC) AS rn
  FROM lines l JOIN promotions p ON l.sale_date BETWEEN p.start_date AND p.end_date
    AND (p.store_id IS NULL OR p.store_id=l.store_id) AND (p.product_id IS NULL OR p.product_id=l.product_id))
SELECT l.sale_date::VARCHAR AS sale_date, l.store_id, l.product_id, units_sold, c.promotion_id, c.promotion_type,
  coalesce(c.discount_percentage, 0)::INT AS promotion_discount, c.promotion_id IS NOT NULL AS on_promotion
FROM lines l LEFT JOIN c ON c.rn=1 AND c.sale_date=l.sale_date AND c.store_id=l.store_id AND c.product_id=l.product_id""",
)
def promotion_interval_join(t):
    out = relational.apply_promotions(t.lines(), t.promotions)
    return out.select(
        "sale_date", "store_id", "product_id", "units_sold", "promotion_id", "promotion_type", "promotion_discount",
        "on_promotion",
    )


@query(
    "holiday_distance",
    "JN-9 FEA-4",
    """
SELECT sale_date::VARCHAR AS sale_date,
  coalesce(sale_date - (SELECT max(date) FROM holidays h WHERE h.date <= s.sale_date), 365)::INT AS days_since_holiday,
  coalesce((SELECT min(date) FROM holidays h WHERE h.date > s.sale_date) - sale_date, 365)::INT AS days_until_holiday
FROM sale_days s""",
)
def holiday_distance(t):
    return relational.holiday_distance(t.sale_days, t.holidays)


@query(
    "holiday_lookback_impact",
    "JN-10 HOL-3",
    f"""
, d AS (SELECT city_id, sale_date, sum(sale_amount) AS a FROM sales GROUP BY 1,2),
b AS (SELECT d.city_id, h.date, h.holiday_name, d.a,
    (SELECT sum(x.a)::DOUBLE/count(*) FROM d x WHERE x.city_id=d.city_id AND x.sale_date BETWEEN h.date-14 AND h.date-1
       AND isodow(x.sale_date)=isodow(h.date)) AS base,
    (SELECT count(*) FROM d x WHERE x.city_id=d.city_id AND x.sale_date BETWEEN h.date-14 AND h.date-1
       AND isodow(x.sale_date)=isodow(h.date)) AS n
  FROM d JOIN holidays h ON h.date=d.sale_date)
SELECT city_id, date::VARCHAR AS date, holiday_name, {q('a')} AS sale_amount, {q('base')} AS baseline_amount,
  CASE WHEN n>0 THEN n END AS baseline_days, {q('a::DOUBLE-base')} AS impact, {q('(a::DOUBLE-base)/nullif(base,0)*100')} AS impact_pct
FROM b""",
)
def holiday_lookback_impact(t):
    return relational.holiday_baseline(t.daily("city_id", category=False), t.holidays, ["city_id"])


@query(
    "recent_sales_or_zero",
    "JN-3 JN-4 FLT-3 FLT-4",
    f"""
, r AS (SELECT product_id, sum(units_sold)::BIGINT u, sum(sale_amount) a, count(*) n FROM lines
  WHERE sale_date >= (SELECT d FROM ref)-90 GROUP BY 1)
SELECT p.product_id, product_name, first_category, coalesce(u,0)::BIGINT AS units_sold, {q('coalesce(a,0)')} AS sale_amount,
  coalesce(n,0)::BIGINT AS "rows" FROM product p LEFT JOIN r ON r.product_id=p.product_id""",
)
def recent_sales_or_zero(t):
    dim = t.product.select("product_id", "product_name", "first_category")
    return relational.recent_or_zero(dim, t.lines(since=t.day(90)), "product_id")


@query(
    "semi_promoted_stores",
    "JN-5",
    f"""
SELECT store_id, count(*) AS n, {q('sum(sale_amount)')} AS amount FROM lines
WHERE store_id IN (SELECT store_id FROM promotions WHERE store_id IS NOT NULL AND promotion_type='bogo') GROUP BY 1""",
)
def semi_promoted_stores(t):
    promos = t.promotions.filter(F.col("promotion_type") == "bogo")
    kept = relational.rows_of_promoted_stores(t.lines(), promos)
    return kept.groupBy("store_id").agg(F.count(F.lit(1)).alias("n"), F.sum("sale_amount").alias("amount"))


@query(
    "anti_promotion_days",
    "JN-6",
    f"""
SELECT product_id, count(*) AS n, {q('sum(units_sold)::DOUBLE/count(*)')} AS mean_units FROM lines l
WHERE NOT EXISTS (SELECT 1 FROM promotions p WHERE p.product_id=l.product_id AND l.sale_date BETWEEN p.start_date AND p.end_date)
GROUP BY 1""",
)
def anti_promotion_days(t):
    kept = relational.rows_off_promotion(t.lines(), t.promotions)
    return kept.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), mean_of("units_sold").alias("mean_units"))


@query(
    "dense_series",
    "JN-14 FLT-5",
    f"""
, d AS (SELECT city_id, first_category, sale_date, sum(units_sold)::BIGINT u, sum(sale_amount) a FROM sales GROUP BY 1,2,3),
g AS (SELECT city_id, first_category, unnest(generate_series(min(sale_date), max(sale_date), INTERVAL 1 DAY))::DATE AS sale_date
  FROM d GROUP BY 1,2)
SELECT g.city_id, g.first_category, g.sale_date::VARCHAR AS sale_date, coalesce(u,0)::BIGINT AS units_sold, {q('coalesce(a,0)')} AS sale_amount
FROM g LEFT JOIN d USING (city_id, first_category, sale_date)""",
)
def dense_series(t):
    return relational.dense_series(t.daily("city_id", "first_category"), ["city_id", "first_category"], ["units_sold", "sale_amount"])


@query(
    "similar_size_stores",
    "FLT-7",
    f"""
, m AS (SELECT store_id, sum(sale_amount) a FROM lines GROUP BY 1), g AS (SELECT a::DOUBLE AS a FROM m WHERE store_id=7)
SELECT store_id, {q('a')} AS amount FROM m WHERE store_id<>7 AND a::DOUBLE BETWEEN (SELECT a FROM g)*0.8 AND (SELECT a FROM g)*1.2""",
)
def similar_size_stores(t):
    m = t.lines().groupBy("store_id").agg(F.sum("sale_amount").cast("double").alias("amount"))
    return relational.similar_size(m, "store_id", "amount", 7)


@query(
    "demand_statistics",
    "AGG-1 AGG-6 AGG-11 JN-4",
    f"""
, d AS (SELECT city_id, first_category, sale_date, sum(units_sold)::BIGINT u FROM sales GROUP BY 1,2,3)
SELECT city_id, first_category, count(*) AS days, {q('sum(u)::DOUBLE/count(*)')} AS mean_units, {q('stddev_samp(u::DOUBLE)')} AS std_units,
  {q('stddev_samp(u::DOUBLE)/(sum(u)::DOUBLE/count(*))')} AS cv_units,
  {q('(count(*) FILTER (WHERE u=0))::DOUBLE/count(*)')} AS zero_ratio,
  min(u) AS min_units, max(u) AS max_units FROM d GROUP BY 1,2 HAVING count(*)>=30""",
)
def demand_statistics(t):
    return summaries.demand_statistics(t.daily("city_id", "first_category"), ["city_id", "first_category"], 30)


@query(
    "concentration_by_city",
    "AGG-12",
    f"""
, p AS (SELECT city_id, second_category, sum(sale_amount) v FROM sales GROUP BY 1,2),
s AS (SELECT *, v::DOUBLE/(sum(v) OVER (PARTITION BY city_id))::DOUBLE*100 AS sh,
  row_number() OVER (PARTITION BY city_id ORDER BY v DESC, second_category) rn FROM p)
SELECT city_id, count(*) AS items, {q('sum(sh*sh)')} AS hhi, {q('sum(CASE WHEN rn<=5 THEN sh END)')} AS top5_share FROM s GROUP BY 1""",
)
def concentration_by_city(t):
    return summaries.concentration(t.sales(), ["city_id"], "second_category", "sale_amount")


@query(
    "best_and_worst_month",
    "AGG-10",
    f"""
, p AS (SELECT first_category, month(sale_date)::INT AS m, sum(sale_amount)::DOUBLE/count(*) AS a FROM sales GROUP BY 1,2)
SELECT first_category, arg_max(m, a) AS best, {q('max(a)')} AS best_mean, arg_min(m, a) AS worst, {q('min(a)')} AS worst_mean
FROM p GROUP BY 1""",
)
def best_and_worst_month(t):
    s = t.sales(geo=False).withColumn("month", F.month("sale_date"))
    return summaries.best_and_worst(s, ["first_category"], "month", "sale_amount")


@query(
    "trend_slopes",
    "AGG-13",
    f"""
, d AS (SELECT city_id, first_category, sale_date, sum(sale_amount)::DOUBLE a FROM sales GROUP BY 1,2,3),
x AS (SELECT *, sale_date - min(sale_date) OVER (PARTITION BY city_id, first_category) AS i FROM d)
SELECT city_id, first_category, count(*) AS days, {q('regr_slope(a, i)')} AS slope FROM x GROUP BY 1,2 HAVING count(*)>10""",
)
def trend_slopes(t):
    return summaries.trend_slopes(t.daily("city_id", "first_category"), ["city_id", "first_category"])


@query(
    "ratio_profile",
    "AGG-17 AGG-2",
    f"""
, d AS (SELECT store_id, sale_amount::DECIMAL(20,2) v, isodow(sale_date)>=6 w, discount>=0.05 p, holiday_flag h FROM sales)
SELECT store_id,
  {q('(sum(v) FILTER (WHERE w)::DOUBLE/count(v) FILTER (WHERE w))/(sum(v) FILTER (WHERE NOT w)::DOUBLE/count(v) FILTER (WHERE NOT w))')} AS weekend_ratio,
  {q('(sum(v) FILTER (WHERE p)::DOUBLE/count(v) FILTER (WHERE p))/(sum(v) FILTER (WHERE NOT p)::DOUBLE/count(v) FILTER (WHERE NOT p))')} AS promo_ratio,
  {q('(sum(v) FILTER (WHERE h)::DOUBLE/nullif(count(v) FILTER (WHERE h),0))/(sum(v) FILTER (WHERE NOT h)::DOUBLE/count(v) FILTER (WHERE NOT h))')} AS holiday_ratio
FROM d GROUP BY 1""",
)
def ratio_profile(t):
    s = t.sales(geo=False, category=False)
    return summaries.ratio_profile(
        s, ["store_id"], "sale_amount", is_weekend(F.col("sale_date")), F.col("activity_flag"), F.col("holiday_flag")
    )


@query(
    "level_rollup",
    "AGG-16",
    f"""
SELECT sale_date::VARCHAR AS sale_date, region_id, store_id, first_category, {q('sum(sale_amount)')} AS total, count(*) AS "rows",
  CASE WHEN region_id IS NOT NULL THEN 'region_id' WHEN store_id IS NOT NULL THEN 'store_id'
    WHEN first_category IS NOT NULL THEN 'first_category' ELSE 'total' END AS level
FROM sales GROUP BY GROUPING SETS ((sale_date, region_id), (sale_date, store_id), (sale_date, first_category), (sale_date))""",
)
def level_rollup(t):
    return summaries.level_rollup(t.sales(), ["region_id", "store_id", "first_category"], "sale_amount")


@query(
    "quality_summary",
    "AGG-18 FLT-4",
    "SELECT count(*) AS sample_size, (max(sale_date)-min(sale_date)+1)::INT AS span_days, "
    + ", ".join(
        f"{q(f'count({c})::DOUBLE/count(*)*100')} AS {c}_complete_pct, {q(f'min({c})')} AS {c}_min, {q(f'max({c})')} AS {c}_max"
        for c in ("sale_amount", "avg_temperature", "discount")
    )
    + " FROM sales",
)
def quality_summary(t):
    return summaries.quality_summary(t.sales(category=False), ["sale_amount", "avg_temperature", "discount"])


@query(
    "sales_profile",
    "AGG-19 FN-13",
    f"""
, x AS (SELECT sale_amount, CASE WHEN holiday_flag THEN 'holiday' ELSE 'regular' END h,
   CASE WHEN discount<=0 THEN 'none' WHEN discount<=0.1 THEN 'up to 10%' WHEN discount<=0.2 THEN 'up to 20%'
     WHEN discount<=0.3 THEN 'up to 30%' ELSE 'over 30%' END b FROM sales)
SELECT h AS label, 'holiday' AS profile, count(*) AS "rows", {q('sum(sale_amount)::DOUBLE/count(*)')} AS mean_amount,
  {q('sum(sale_amount)')} AS total_amount FROM x GROUP BY 1
UNION ALL SELECT b, 'discount', count(*), {q('sum(sale_amount)::DOUBLE/count(*)')}, {q('sum(sale_amount)')} FROM x GROUP BY 1""",
)
def sales_profile(t):
    return summaries.sales_profile(t.sales(geo=False, category=False))


@query(
    "weather_profile",
    "AGG-19 SRT-2",
    "SELECT city_id, count(*) AS days, "
    + ", ".join(
        f"{q(f'min({c})')} AS {c}_min, {q(f'avg({c})')} AS {c}_mean, {q(f'max({c})')} AS {c}_max"
        for c in ("avg_temperature", "avg_humidity", "precpt", "avg_wind_level")
    )
    + " FROM weather GROUP BY city_id",
)
def weather_profile(t):
    return summaries.weather_profile(t.weather)


@query(
    "store_statistics",
    "AGG-20",
    f"""
SELECT store_id, count(*) AS sales_count, {q('sum(sale_amount)')} AS total_amount, {q('sum(units_sold)::DOUBLE/count(*)')} AS avg_units,
  min(sale_date)::VARCHAR AS first_sale, max(sale_date)::VARCHAR AS last_sale FROM lines GROUP BY 1""",
)
def store_statistics(t):
    return summaries.store_statistics(t.lines())


@query(
    "label_lists",
    "AGG-7",
    f"""
SELECT first_category, count(*) AS products, {q('sum(list_price)::DOUBLE/count(*)')} AS avg_price,
  string_agg(DISTINCT second_category, ', ' ORDER BY second_category) AS labels FROM product GROUP BY 1""",
)
def label_lists(t):
    return summaries.label_lists(t.product)


@query(
    "daily_view",
    "SRC-18 AGG-4",
    f"""
SELECT sale_date::VARCHAR AS sale_date, store_id, city_id, product_id, first_category, second_category,
  {q('sum(sale_amount)')} AS total_amount, sum(units_sold)::BIGINT AS total_units,
  {q('sum(discount)::DOUBLE/count(*)')} AS avg_discount, count(*) AS transactions, bool_or(holiday_flag) AS is_holiday,
  bool_or(activity_flag) AS is_promo FROM sales GROUP BY ALL""",
)
def daily_view(t):
    return summaries.daily_view(t.sales())


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "category_day_matrix",
    "AGG-15",
    f"""
SELECT sale_date::VARCHAR AS sale_date, {', '.join(q(f"coalesce({MEAN('sale_amount', f"first_category='{k}'")},0)") + f' AS {k.lower()}' for k in _TYPES)}
FROM sales GROUP BY sales.sale_date""",
)
def category_day_matrix(t):
    return summaries.entity_day_matrix(t.sales(geo=False), "first_category", "sale_amount", t.product)


@query(
    "amount_percentiles",
    "AGG-8 AGG-9",
    "SELECT first_category, "
    + ", ".join(
        f"{q(f'quantile_cont(sale_amount::DOUBLE, {p})')} AS {n}"
        for n, p in (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))
    )
    + " FROM sales GROUP BY 1",
)
def amount_percentiles(t):
    probs = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    return ranking.exact_quantiles(t.sales(geo=False), "sale_amount", probs, ["first_category"])


@query(
    "ordered_series_scan",
    "CMB-3 WIN-11",
    f"""
, d AS (SELECT city_id, first_category, sale_date, sum(units_sold)::BIGINT u, sum(sale_amount) a FROM sales GROUP BY 1,2,3),
r AS (SELECT *, row_number() OVER (PARTITION BY city_id, first_category ORDER BY sale_date DESC) rn FROM d)
SELECT r.city_id, first_category, sale_date::VARCHAR AS sale_date, u AS units_sold, {q('a')} AS sale_amount, rn::INT AS from_end,
  (isodow(sale_date)-1)::INT AS day_of_week, city_name FROM r JOIN city USING (city_id) WHERE rn<=90""",
)
def ordered_series_scan(t):
    d = t.daily("city_id", "first_category").select("city_id", "first_category", "sale_date", "units_sold", "sale_amount")
    top = ranking.top_per_group(d, ["city_id", "first_category"], [F.desc("sale_date")], 90, "from_end")
    return top.withColumn("day_of_week", F.weekday("sale_date")).join(t.city.select("city_id", "city_name"), "city_id")
