"""The parts of model, cluster and significance operators that SQL can express: inputs, splits, baselines, group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import finite
from ..operators import clustering as clu
from ..operators import correlation as cor
from ..operators import features
from ..operators import forecast as fc
from ..operators import uplift as up
from .clustering import VECTOR
from .correlation import _FACT, _SALL
from .features import MEAN
from .forecast import _UK, _daily_weather, _weather_rows
from .registry import corr_sql, q, query
from .series import KEYS

# ---- values and significance ---------------------------------------------------------------------


@query(
    "finite_values",
    "FN-23",
    """
SELECT CASE product_id%4 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN '-inf' ELSE 'number' END AS kind, count(*) AS "rows", count(*) FILTER (WHERE product_id%4=3) AS finite_rows,
  sum(CASE WHEN product_id%4=3 THEN units_sold::DOUBLE END) AS finite_sum FROM lines GROUP BY 1""",
)
def finite_values(t):
    kind = F.col("product_id") % 4
    raw = F.when(kind == 0, "NaN").when(kind == 1, "Infinity").when(kind == 2, "-Infinity").otherwise(F.col("units_sold").cast("string"))
    x = finite(raw.cast("double"))
    label = F.when(kind == 0, "nan").when(kind == 1, "inf").when(kind == 2, "-inf").otherwise("number")
    return t.lines().groupBy(label.alias("kind")).agg(F.count(F.lit(1)).alias("rows"), F.count(x).alias("finite_rows"), F.sum(x).alias("finite_sum"))


@query(
    "correlation_significance",
    "COR-2",
    f"""{_SALL}
SELECT item_a, item_b, {q('r')} AS r, sample_size, {q('r*sqrt((sample_size-2)/(1-r*r))', 2)} AS t_statistic FROM ra WHERE abs(r)>=0.3 AND abs(r)<0.999""",
)
def correlation_significance(t):
    pairs = cor.cell_correlations(t.lines(since=t.day(90)), "product_id", ["sale_date", "store_id"], "units_sold", 0.3)
    r, n = F.col("r"), F.col("sample_size")
    stat = r * F.sqrt((n - 2) / (1 - r * r))
    return pairs.filter(F.abs("r") < 0.999).select("item_a", "item_b", "r", "sample_size", (F.floor(stat * 100 + 0.500003) / 100).alias("t_statistic"))


# ---- forecast inputs and baselines -----------------------------------------------------------------

_W = "PARTITION BY city_id, first_category ORDER BY sale_date"


def _mean(n):
    f = f"OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(a) {f}={n} THEN avg(a::DOUBLE) {f} END"


_ROWS = f"""
, d AS (SELECT city_id, first_category, sale_date, sum(sale_amount) a, max(discount) dc, bool_or(holiday_flag) hf, any_value(avg_temperature) tp, any_value(avg_humidity) hu, any_value(precpt) pr FROM sales GROUP BY 1,2,3),
fr AS (SELECT *, lag(a,1) OVER ({_W}) l1, lag(a,7) OVER ({_W}) l7, lag(a,30) OVER ({_W}) l30, {_mean(7)} m7, {_mean(30)} m30, {_mean(7)}-{_mean(14)} tr, (sale_date-(SELECT min(sale_date) FROM d))::INT ds FROM d),
fo AS (SELECT * FROM fr WHERE l30 IS NOT NULL AND m30 IS NOT NULL)"""


def _baseline(rows, label):
    """Baseline error in SQL over a CTE ``rows`` with sale_date and a label."""
    return f"""
, cu AS (SELECT min(sale_date)+trunc((max(sale_date)-min(sale_date))*0.8)::INT c FROM {rows}),
bm AS (SELECT avg({label}::DOUBLE) m FROM {rows}, cu WHERE sale_date<=c)
SELECT count(*) AS "rows", {q(f'avg(abs({label}::DOUBLE-m))')} AS mae, {q(f'avg(({label}::DOUBLE-m)*({label}::DOUBLE-m))', 2)} AS mse FROM {rows}, cu, bm WHERE sale_date>c"""


def _baseline_error(rows):
    return fc.baseline_error(rows).withColumn("mse", F.floor(F.col("mse") * 100 + 0.500003) / 100)


@query(
    "forest_inputs",
    "FC-2 FEA-10 FEA-12",
    f"""{_ROWS}
SELECT city_id, first_category, sale_date::VARCHAR AS sale_date, (isodow(sale_date)-1)::DOUBLE AS day_of_week, month(sale_date)::DOUBLE AS month, quarter(sale_date)::DOUBLE AS quarter,
  (isodow(sale_date)>=6)::INT::DOUBLE AS is_weekend, ds::DOUBLE AS days_since_start, tp AS avg_temperature, hu AS avg_humidity, pr AS precpt, dc::DOUBLE AS discount, hf::INT::DOUBLE AS holiday_flag,
  {q('l1')} AS lag_1, {q('l7')} AS lag_7, {q('l30')} AS lag_30, {q('m7')} AS roll_mean_7, {q('m30')} AS roll_mean_30, {q('tr')} AS trend, {q('a')} AS label FROM fo""",
)
def forest_inputs(t):
    return fc.forest_rows(_daily_weather(t), KEYS)


@query("forest_baseline", "FC-2", f"{_ROWS}{_baseline('fo', 'a')}")
def forest_baseline(t):
    return _baseline_error(fc.forest_rows(_daily_weather(t), KEYS))


@query("forest_scores", "FC-2")
def forest_scores(t):
    return fc.forest_scores(fc.forest_rows(_daily_weather(t), KEYS))


@query(
    "seasonal_fit_rows",
    "FC-3",
    f"""
, d AS (SELECT city_id, first_category, sale_date, sum(sale_amount) a FROM sales GROUP BY 1,2,3)
SELECT city_id, first_category, count(*) AS "rows", (max(sale_date)-min(sale_date))::INT AS span_days, {q('avg(a::DOUBLE)')} AS mean_amount, (max(sale_date)+1)::VARCHAR AS first_ahead, (max(sale_date)+14)::VARCHAR AS last_ahead
FROM d GROUP BY 1,2 HAVING count(*)>=30""",
)
def seasonal_fit_rows(t):
    """What the seasonal regression fits and the days it must return, joined with the days it does return."""
    d = _daily_weather(t)
    fitted = d.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.date_diff(F.max("sale_date"), F.min("sale_date")).alias("span_days"), F.avg(F.col("sale_amount").cast("double")).alias("mean_amount")
    )
    ahead = fc.seasonal_forecast(d, KEYS, 14, regressors=["avg_temperature", "precpt", "discount"], min_rows=30)
    return fitted.join(ahead.groupBy(*KEYS).agg(F.min("date").alias("first_ahead"), F.max("date").alias("last_ahead")), KEYS)


@query(
    "category_baseline",
    "FC-6",
    f"""
, cd AS (SELECT first_category, sale_date, sum(sale_amount) a FROM sales GROUP BY 1,2){_baseline('cd', 'a')}""",
)
def category_baseline(t):
    return _baseline_error(t.daily("first_category", geo=False).withColumn("label", F.col("sale_amount").cast("double")))


@query(
    "weather_baseline",
    "FC-7 FC-8 FC-9 CMB-8",
    f"""
, d AS (SELECT city_id, sale_date, sum(units_sold)::BIGINT u FROM sales GROUP BY 1,2),
wr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY sale_date) rn FROM d) WHERE rn>7){_baseline('wr', 'u')}""",
)
def weather_baseline(t):
    return _baseline_error(_weather_rows(t))


# ---- promotions and stock-outs ---------------------------------------------------------------------


@query(
    "uplift_split",
    "UPL-1",
    f"""
, b AS (SELECT store_id, first_category, {MEAN('sale_amount')} m FROM sales WHERE NOT activity_flag GROUP BY 1,2),
r AS (SELECT sale_amount::DOUBLE-m AS label, ('0x' || substr(md5(strftime(sale_date, '%Y-%m-%d') || '_' || store_id || '_' || product_id),1,7))::BIGINT % 10 AS p FROM sales JOIN b USING (store_id, first_category) WHERE activity_flag)
SELECT CASE WHEN p<8 THEN 'train' ELSE 'test' END AS part, count(*) AS "rows", {q('avg(label)')} AS mean_label FROM r GROUP BY 1""",
)
def uplift_split(t):
    train, test = up.split_rows(up.uplift_rows(t.sales(), _UK))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.avg("label").alias("mean_label"))


@query(
    "simulation_groups",
    "PRM-8",
    f"""
, g AS (SELECT store_id, first_category, count(*) n, {MEAN('sale_amount', 'NOT activity_flag')} m, avg(avg_temperature) tp, avg(avg_humidity) hu, avg(precpt) pr, avg(month(sale_date)) mo, avg(isodow(sale_date)-1) dw FROM sales GROUP BY 1,2 HAVING count(*)>=10)
SELECT store_id, first_category, n AS "rows", {q('m')} AS regular_mean, {q('tp')} AS avg_temperature, {q('hu')} AS avg_humidity, {q('pr')} AS precpt, {q('mo')} AS month, {q('dw')} AS day_of_week FROM g WHERE m IS NOT NULL""",
)
def simulation_groups(t):
    return up.simulation_groups(t.sales(), _UK)


@query(
    "discount_rows",
    "PRM-12",
    f"""
, b AS (SELECT store_id, first_category, {MEAN('sale_amount', 'discount=0')} base FROM sales GROUP BY 1,2 HAVING count(*) FILTER (WHERE discount>0)>=20),
r AS (SELECT store_id, first_category, base, discount::DOUBLE*100 dp, (sale_amount::DOUBLE-base)/(discount::DOUBLE*100) label FROM sales JOIN b USING (store_id, first_category) WHERE discount>0 AND base IS NOT NULL)
SELECT store_id, first_category, count(*) AS "rows", {q('any_value(base)')} AS base, {q('avg(dp)')} AS mean_discount, {q('avg(label)')} AS mean_label FROM r GROUP BY 1,2""",
)
def discount_rows(t):
    rows = up.discount_rows(t.sales(), _UK)
    return rows.groupBy(*_UK).agg(
        F.count(F.lit(1)).alias("rows"), F.first("base").alias("base"), F.avg("discount_pct").alias("mean_discount"), F.avg("label").alias("mean_label")
    )


@query(
    "stockout_hour_classes",
    "CLS-1",
    """
SELECT hour_of_day, is_out::INT::DOUBLE AS label, count(*)::DOUBLE AS weight FROM hourly GROUP BY 1,2""",
)
def stockout_hour_classes(t):
    return up.stockout_hours(t.sales(category=False)).groupBy("hour_of_day", "label").agg(F.sum("_w").alias("weight"))


# ---- clusters --------------------------------------------------------------------------------------


def _vector_sql(entity):
    return f"""
, b AS (SELECT {entity}, sum(sale_amount)::DOUBLE total_amount, {MEAN('sale_amount')} mean_amount, (count(*) FILTER (WHERE stock_hour6_22_cnt>0))::DOUBLE/count(*) stockout_rate,
   coalesce({corr_sql('sale_amount', 'avg_temperature')},0) temp_corr, coalesce({corr_sql('sale_amount', 'avg_humidity')},0) humidity_corr, coalesce({corr_sql('sale_amount', 'precpt')},0) rain_corr,
   coalesce({MEAN('sale_amount', 'discount>0')}/{MEAN('sale_amount', 'discount=0')},1) discount_response, {MEAN('discount')} mean_discount FROM sales GROUP BY 1),
dd AS (SELECT {entity}, sale_date, sum(units_sold)::BIGINT u FROM sales GROUP BY 1,2),
c AS (SELECT {entity}, count(*)::DOUBLE active_days, coalesce(stddev_samp(u::DOUBLE)/{MEAN('u')},0) demand_cv FROM dd GROUP BY 1),
v AS (SELECT * FROM b JOIN c USING ({entity}))"""


def _standard(c):
    return f"coalesce(({c}-avg({c}) OVER ())/nullif(stddev_samp({c}) OVER (),0),0)"


@query(
    "cluster_inputs",
    "CLU-1 CLU-2 CLU-3 FEA-15 CMB-9",
    f"""{_vector_sql('store_id')}
SELECT store_id, {', '.join(f'{q(_standard(c))} AS {c}' for c in VECTOR)} FROM v""",
)
def cluster_inputs(t):
    return clu.standardised(features.entity_vector(t.sales(category=False), "store_id"), "store_id", VECTOR)


_DENSE = ["total_amount", "mean_amount", "active_days", "stockout_rate"]


@query(
    "density_core_points",
    "CLU-4",
    f"""{_vector_sql('store_id')}
, z AS (SELECT store_id AS id, {', '.join(f'{_standard(c)} AS {c}' for c in _DENSE)} FROM v),
ds AS (SELECT a.id, sqrt({'+'.join(f'pow(a.{c}-b.{c},2)' for c in _DENSE)}) AS dist, a.id=b.id AS own FROM z a, z b),
kd AS (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) rn FROM ds WHERE NOT own),
ep AS (SELECT quantile_cont(dist, 0.75)+1e-9 AS e FROM kd WHERE rn=3)
SELECT id, count(*) FILTER (WHERE dist<=e) AS n, count(*) FILTER (WHERE dist<=e)>=5 AS core FROM ds, ep GROUP BY 1""",
)
def density_core_points(t):
    core, _ = clu.density_core(features.entity_vector(t.sales(category=False), "store_id"), "store_id", _DENSE)
    return core.select("id", "n", "core")


def _grouped(t):
    """Products grouped by a formula of their id, in place of a clustering."""
    return features.entity_vector(t.sales(category=False), "product_id").withColumn("cluster", (F.col("product_id") % 4).cast("int"))


_LONG = f"""{_vector_sql('product_id')}
, lo AS ({' UNION ALL '.join(f"SELECT (product_id%4)::INT AS cluster, '{c}' AS feature, {c}::DOUBLE AS x FROM v" for c in VECTOR)}),
ft AS (SELECT feature, avg(x) tm, stddev_pop(x) ts FROM lo GROUP BY 1),
fg AS (SELECT cluster, feature, count(*) n, avg(x) m, stddev_samp(x) sd, min(x) mn, max(x) mx, var_pop(x) vp FROM lo GROUP BY 1,2),
fp AS (SELECT *, (m-tm)/ts z FROM fg JOIN ft USING (feature))"""


@query(
    "group_quality",
    "CLU-5",
    f"""{_LONG}
, g AS (SELECT count(DISTINCT cluster) k, (sum(n)/{len(VECTOR)})::BIGINT n, sum(n*vp) w, sum(n*(m-tm)*(m-tm)) b FROM fp)
SELECT k AS clusters, n AS "rows", {q('(b/(k-1))/(w/(n-k))')} AS calinski_harabasz FROM g""",
)
def group_quality(t):
    return clu.cluster_quality(_grouped(t), VECTOR).drop("inertia")


@query(
    "group_profiles",
    "CLU-6 CLU-7 CLU-9",
    f"""{_LONG}
, lv AS (SELECT cluster, max(n) AS size, max(z) FILTER (WHERE feature='total_amount') AS lz FROM fp GROUP BY 1)
SELECT cluster, size, {q('lz')} AS level_z, CASE WHEN lz>=0.75 THEN 'High' WHEN lz>=0.25 THEN 'Above average' WHEN lz>=-0.25 THEN 'Average' WHEN lz>=-0.75 THEN 'Below average' ELSE 'Low' END AS name,
  {q('size::DOUBLE/sum(size) OVER ()')} AS share, CASE WHEN lz>=0.75 THEN 'protect' WHEN lz>=0.25 THEN 'grow' WHEN lz>=-0.25 THEN 'maintain' WHEN size::DOUBLE/sum(size) OVER ()<0.1 THEN 'review' ELSE 'improve' END AS advice,
  CASE WHEN abs(lz)>=0.75 THEN 'high' WHEN abs(lz)>=0.25 THEN 'medium' ELSE 'low' END AS priority FROM lv""",
)
def group_profiles(t):
    names = clu.cluster_names(clu.cluster_profiles(_grouped(t), VECTOR), "total_amount")
    return clu.cluster_insights(names).drop("main_feature", "main_z")


@query(
    "group_representatives",
    "CLU-7",
    """
, g AS (SELECT p_partkey AS product_id, (p_partkey%4)::INT AS cluster, ((p_partkey*37)%101)::DOUBLE AS distance FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, product_id) AS place FROM g)
SELECT cluster, place::INT AS place, product_id, distance FROM r WHERE place<=5""",
)
def group_representatives(t):
    p = t.product.select("product_id", (F.col("product_id") % 4).cast("int").alias("cluster"), ((F.col("product_id") * 37) % 101).cast("double").alias("distance"))
    return clu.representatives(p, "product_id", 5)


@query(
    "weather_sensitivity_inputs",
    "CLU-8",
    f"""{_FACT}
SELECT product_id, {', '.join(f"{q(f'''max(r) FILTER (WHERE factor='{c}')''')} AS {c}" for c in ('temperature', 'humidity', 'precipitation', 'wind', 'comfort'))} FROM g GROUP BY 1""",
)
def weather_sensitivity_inputs(t):
    names = ["temperature", "humidity", "precipitation", "wind", "comfort"]
    return cor.factor_correlations(t.sales(category=False), "product_id").groupBy("product_id").pivot("factor", names).agg(F.max("r"))


@query(
    "group_bands",
    "CMB-9",
    f"""
, g AS (SELECT (s_suppkey%5)::INT AS cluster, count(*) AS members, avg(s_acctbal::DOUBLE) AS m FROM supplier GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY m DESC, cluster) AS place, count(*) OVER () AS n FROM g)
SELECT cluster, members, {q('m')} AS mean_value, place::INT AS place, CASE WHEN place/n::DOUBLE<=1/3::DOUBLE THEN 'high' WHEN place/n::DOUBLE<=2/3::DOUBLE THEN 'medium' ELSE 'low' END AS band FROM r""",
)
def group_bands(t):
    s = t.raw("supplier").select((F.col("s_suppkey") % 5).cast("int").alias("cluster"), F.col("s_acctbal").alias("value"))
    return clu.performance_bands(s, "value")
