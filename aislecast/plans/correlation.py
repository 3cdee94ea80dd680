"""Correlation, portfolio and category queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import categories as cat
from ..operators import correlation as cor
from ..operators import portfolio as pfl
from ..operators.relational import dense_series
from .features import MEAN
from .registry import corr_sql, q, query

_PAIRS = f"""
, c AS (SELECT product_id, sale_date, {MEAN('sale_amount')} x FROM lines WHERE sale_date>=(SELECT d FROM ref)-90 GROUP BY 1,2),
n AS (SELECT count(DISTINCT sale_date)::DOUBLE n FROM c),
p AS (SELECT product_id, sum(x) s, sum(x*x) ss FROM c GROUP BY 1),
xy AS (SELECT a.product_id pa, b.product_id pb, sum(a.x*b.x) sxy FROM c a JOIN c b ON a.sale_date=b.sale_date AND a.product_id<b.product_id GROUP BY 1,2),
r AS (SELECT a.product_id item_a, b.product_id item_b,
   (n*coalesce(sxy,0)-a.s*b.s)/sqrt((n*a.ss-a.s*a.s)*(n*b.ss-b.s*b.s)) r
  FROM p a JOIN p b ON a.product_id<b.product_id LEFT JOIN xy ON pa=a.product_id AND pb=b.product_id, n
  WHERE n*a.ss-a.s*a.s>0 AND n*b.ss-b.s*b.s>0)"""


@query(
    "product_correlations",
    "COR-1 JN-13 AGG-15",
    f"""{_PAIRS}
SELECT item_a, item_b, {q('r')} AS r, CASE WHEN r>0.7 THEN 'complementary' WHEN r<-0.5 THEN 'substitute' ELSE 'neutral' END AS correlation_type FROM r WHERE abs(r)>=0.3""",
)
def product_correlations(t):
    return cor.product_correlations(t.lines(since=t.day(90)))


@query(
    "correlated_with_product",
    "FLT-6 SRT-1",
    f"""{_PAIRS}
SELECT item_a, item_b, {q('r')} AS r FROM r WHERE abs(r)>=0.3 AND (item_a=7 OR item_b=7 OR item_a=1 OR item_b=1 OR item_a=100 OR item_b=100)""",
)
def correlated_with_product(t):
    pairs = cor.correlations_with(t.lines(since=t.day(90)), [7, 1, 100])
    return pairs.orderBy(F.abs("r").desc(), "item_a", "item_b")


@query("correlation_p_values", "COR-2 COR-8")
def correlation_p_values(t):
    pairs = cor.cell_correlations(t.lines(since=t.day(90)), "product_id", ["sale_date", "store_id"], "units_sold", 0.3)
    return pairs.select(
        "item_a",
        "item_b",
        "r",
        "sample_size",
        cor.p_value(F.col("r"), F.col("sample_size")).alias("p_value"),
        cor.pair_label(F.col("r")).alias("label"),
    )


_SPAIRS = f"""
, c AS (SELECT product_id, sale_date, store_id, {MEAN('units_sold')} x FROM lines WHERE sale_date>=(SELECT d FROM ref)-90 GROUP BY 1,2,3),
n AS (SELECT count(DISTINCT (sale_date, store_id))::DOUBLE n FROM c),
p AS (SELECT product_id, sum(x) s, sum(x*x) ss FROM c GROUP BY 1),
xy AS (SELECT a.product_id pa, b.product_id pb, sum(a.x*b.x) sxy FROM c a JOIN c b ON a.sale_date=b.sale_date AND a.store_id=b.store_id AND a.product_id<b.product_id GROUP BY 1,2),
r AS (SELECT pa item_a, pb item_b, n::BIGINT sample_size, (n*sxy-a.s*b.s)/sqrt((n*a.ss-a.s*a.s)*(n*b.ss-b.s*b.s)) r
  FROM xy JOIN p a ON a.product_id=pa JOIN p b ON b.product_id=pb, n)"""
_BUNDLES = f"""{_SPAIRS}
, dy AS (SELECT product_id, {MEAN('units_sold')}*25 rv, count(DISTINCT store_id) st FROM lines WHERE sale_date>=(SELECT d FROM ref)-90 GROUP BY 1),
b AS (SELECT item_a, item_b, r, a.rv ra, c2.rv rb, (a.rv+c2.rv)*30 rp, least(0.95,(r+0.5)*0.8) sp, greatest(5, least(20,(1-r)*30)) dc, least(a.st,c2.st) st
  FROM r JOIN dy a ON a.product_id=item_a JOIN dy c2 ON c2.product_id=item_b WHERE r>=0.4 AND (a.rv+c2.rv)*30>=1000)"""


_SALL = f"""{_SPAIRS}
, ra AS (SELECT a.product_id item_a, b.product_id item_b, n::BIGINT sample_size, (n*coalesce(sxy,0)-a.s*b.s)/sqrt((n*a.ss-a.s*a.s)*(n*b.ss-b.s*b.s)) r
  FROM p a JOIN p b ON a.product_id<b.product_id LEFT JOIN xy ON pa=a.product_id AND pb=b.product_id, n)"""


@query("store_day_correlations", "COR-1 JN-13", f"{_SALL}\nSELECT item_a, item_b, {q('r')} AS r, sample_size FROM ra WHERE abs(r)>=0.3")
def store_day_correlations(t):
    return cor.cell_correlations(t.lines(since=t.day(90)), "product_id", ["sale_date", "store_id"], "units_sold", 0.3)


def _bundles(t):
    s = t.lines(since=t.day(90))
    return pfl.bundles(s, s, min_rows=1)


@query(
    "bundle_opportunities",
    "PFL-2",
    f"""{_BUNDLES}
SELECT item_a, item_b, {q('r')} AS r, {q('ra')} AS revenue_a, {q('rb')} AS revenue_b, {q('rp')} AS revenue_potential, {q('sp')} AS success_probability, {q('dc')} AS discount, st AS stores FROM b""",
)
def bundle_opportunities(t):
    return _bundles(t)


_YEAR = _BUNDLES.replace("-90", "-365").replace("r>=0.4", "r>=0.1")


@query(
    "bundle_triples",
    "PFL-2 JN-15 SET-4",
    f"""{_YEAR}
, tb AS (SELECT * FROM b WHERE r>=0.3),
en AS (SELECT item_a h, item_b l, r, ra hr, rb lr FROM tb UNION ALL SELECT item_b, item_a, r, rb, ra FROM tb),
t3 AS (SELECT x.h, x.l la, y.l lb, (x.r+y.r)/2 av, (x.hr+x.lr+y.lr)*30 rv FROM en x JOIN en y ON x.h=y.h AND x.l<y.l)
SELECT h AS hub, la AS leaf_a, lb AS leaf_b, {q('av')} AS r, {q('least(0.9, av*0.7)')} AS success_probability, {q('rv')} AS revenue_potential FROM t3 WHERE rv>=1500""",
)
def bundle_triples(t):
    # bundles over a year of correlations, so that chains occur
    s = t.lines(since=t.day(365))
    return pfl.bundle_triples(pfl.bundles(s, s, min_corr=0.1, min_rows=1), min_corr=0.3)


@query(
    "category_correlations",
    "COR-3",
    f"""
, c AS (SELECT first_category k, sale_date, sum(sale_amount)::DOUBLE x FROM sales GROUP BY 1,2), n AS (SELECT count(DISTINCT sale_date)::DOUBLE n FROM c),
p AS (SELECT k, sum(x) s, sum(x*x) ss FROM c GROUP BY 1), xy AS (SELECT a.k ka, b.k kb, sum(a.x*b.x) sxy FROM c a JOIN c b ON a.sale_date=b.sale_date AND a.k<b.k GROUP BY 1,2),
r AS (SELECT ka, kb, (n*sxy-a.s*b.s)/sqrt((n*a.ss-a.s*a.s)*(n*b.ss-b.s*b.s)) r FROM xy JOIN p a ON a.k=ka JOIN p b ON b.k=kb, n)
SELECT ka AS item_a, kb AS item_b, {q('r')} AS r, CASE WHEN abs(r)>0.5 THEN 'strong' WHEN abs(r)<0.3 THEN 'weak' ELSE 'moderate' END AS strength FROM r""",
)
def category_correlations(t):
    return cor.category_correlations(t.sales(geo=False))


@query(
    "correlation_overview",
    "COR-3",
    f"""
, c AS (SELECT second_category k, sale_date, sum(sale_amount)::DOUBLE x FROM sales GROUP BY 1,2), n AS (SELECT count(DISTINCT sale_date)::DOUBLE n FROM c),
p AS (SELECT k, sum(x) s, sum(x*x) ss FROM c GROUP BY 1), xy AS (SELECT a.k ka, b.k kb, sum(a.x*b.x) sxy FROM c a JOIN c b ON a.sale_date=b.sale_date AND a.k<b.k GROUP BY 1,2),
r AS (SELECT ka, kb, (n*sxy-a.s*b.s)/sqrt((n*a.ss-a.s*a.s)*(n*b.ss-b.s*b.s)) r FROM xy JOIN p a ON a.k=ka JOIN p b ON b.k=kb, n)
SELECT count(*) AS pairs, {q('avg(abs(r))*100')} AS cross_impact, CASE WHEN max(abs(r))>0.7 THEN 'High' WHEN max(abs(r))>0.5 THEN 'Medium' ELSE 'Low' END AS substitution_risk FROM r""",
)
def correlation_overview(t):
    return cor.correlation_overview(cor.category_correlations(t.sales(geo=False), "second_category"))


_WC = ", ".join(
    f"{q(corr_sql('sale_amount', c))} AS {n}"
    for c, n in (("avg_temperature", "temperature_corr"), ("avg_humidity", "humidity_corr"), ("precpt", "precipitation_corr"))
)


@query(
    "weather_correlations",
    "COR-4 WEA-12 AGG-5 AGG-6",
    f"""
SELECT city_id, first_category, count(*) AS "rows", {q(MEAN('sale_amount'))} AS avg_value, {_WC} FROM sales GROUP BY 1,2 HAVING count(*)>=30""",
)
def weather_correlations(t):
    return cor.weather_correlations(t.sales(), ["city_id", "first_category"])


@query(
    "product_weather_view",
    "COR-5",
    f"""
SELECT s.product_id, count(*) AS "rows", count(DISTINCT store_id) AS stores_carrying, {q('sum(sale_amount)')} AS total_revenue, {q(MEAN('sale_amount'))} AS avg_daily_sales, {_WC},
  {q('(count(*) FILTER (WHERE stock_hour6_22_cnt>0))::DOUBLE/count(*)')} AS stockout_rate, any_value(product_name) AS product_name
FROM sales s JOIN product p ON p.product_id=s.product_id GROUP BY 1 HAVING count(*)>=30""",
)
def product_weather_view(t):
    return cor.product_weather_view(t.sales(category=False), t.product)


_FACTORS = {
    "temperature": "avg_temperature", "humidity": "avg_humidity", "precipitation": "precpt", "wind": "avg_wind_level",
    "temp_humidity": "avg_temperature*avg_humidity/100", "temp_squared": "avg_temperature*avg_temperature",
    "comfort": "1-abs(avg_temperature-22.5::DOUBLE)/30",
}
_FACT = ", f AS (" + " UNION ALL ".join(
    f"SELECT product_id, '{n}' factor, count(*) n, {corr_sql('sale_amount', '(' + e + ')')} r FROM sales GROUP BY 1" for n, e in _FACTORS.items()
) + "), g AS (SELECT * FROM f WHERE r IS NOT NULL)"


@query(
    "factor_correlations",
    "COR-6 COR-8 FN-14",
    f"""{_FACT}
SELECT product_id, n AS "rows", factor, {q('r')} AS r, CASE WHEN abs(r)>=0.7 THEN 'strong' WHEN abs(r)>=0.4 THEN 'moderate' WHEN abs(r)>=0.2 THEN 'weak' ELSE 'very_weak' END AS strength,
  CASE WHEN r>0 THEN 'positive' ELSE 'negative' END AS direction, abs(r)>0.3 AND n>30 AS significant FROM g""",
)
def factor_correlations(t):
    return cor.factor_correlations(t.sales(category=False), "product_id")


@query(
    "primary_weather_factor",
    "COR-6",
    f"""{_FACT}
SELECT product_id, arg_max(factor, abs(r)) AS primary_factor, {q('max(abs(r))')} AS max_abs_r, {q('avg(abs(r))')} AS mean_abs_r,
  CASE WHEN max(abs(r))>=0.6 THEN 'high' WHEN max(abs(r))>=0.3 THEN 'medium' ELSE 'low' END AS sensitivity FROM g GROUP BY 1""",
)
def primary_weather_factor(t):
    return cor.primary_factor(cor.factor_correlations(t.sales(category=False), "product_id"), "product_id")


@query(
    "feature_importance",
    "COR-7",
    " UNION ALL ".join(
        ("SELECT " if i else "SELECT ") + f"'{c}' AS feature, {q('abs(' + corr_sql(c, 'sale_amount') + ')')} AS importance FROM sales"
        for i, c in enumerate(("units_sold", "discount", "avg_temperature", "avg_humidity", "precpt", "stock_hour6_22_cnt"))
    ),
)
def feature_importance(t):
    cols = ["units_sold", "discount", "avg_temperature", "avg_humidity", "precpt", "stock_hour6_22_cnt"]
    return cor.feature_importance(t.sales(category=False), "sale_amount", cols)


_AFF = """
, c AS (SELECT store_id, sale_date, first_category k, count(*) n, sum(units_sold)::BIGINT s FROM sales GROUP BY 1,2,3),
a AS (SELECT x.k ka, y.k kb, sum(x.n*y.n)::BIGINT n, sum(x.s*y.n+y.s*x.n)::DOUBLE u FROM c x JOIN c y ON x.store_id=y.store_id AND x.sale_date=y.sale_date AND x.k<>y.k GROUP BY 1,2)"""


@query(
    "category_affinity",
    "AGG-14 JN-7 CUS-6",
    f"""{_AFF}
SELECT ka AS category_a, kb AS category_b, n AS cooccurrences, {q('u/n')} AS avg_combined_units, {q('u*25')} AS combined_revenue FROM a WHERE n>=10 ORDER BY n DESC, ka, kb LIMIT 10""",
)
def category_affinity(t):
    return cor.category_affinity(t.sales(geo=False))


_PERF = f"""
, pp AS (SELECT product_id, count(DISTINCT store_id) sp, sum(units_sold)::BIGINT tu, sum(units_sold)*25.0::DOUBLE tr, {MEAN('units_sold')} av, stddev_samp(units_sold::DOUBLE) sd, count(*) n,
  min(sale_date) f, max(sale_date) l FROM lines WHERE units_sold>0 GROUP BY 1 HAVING count(*)>=7),
pq AS (SELECT *, tr/sum(tr) OVER () sh, 1/(sd+1) cs, tr/max(tr) OVER ()/(sd+1) star, rank() OVER (ORDER BY tr DESC)::INT rr, rank() OVER (ORDER BY av DESC)::INT sr FROM pp)"""


@query(
    "product_performance",
    "PFL-1 WIN-1 WIN-2",
    f"""{_PERF}
SELECT product_id, sp AS store_presence, tu AS total_units, {q('tr')} AS total_revenue, {q('av')} AS avg_daily_sales, {q('sd')} AS sales_stddev, n AS days_active, f::VARCHAR AS first_sale, l::VARCHAR AS last_sale,
  {q('sh')} AS revenue_share, {q('cs')} AS consistency, {q('star')} AS star_score, rr AS revenue_rank, sr AS sales_rank FROM pq""",
)
def product_performance(t):
    return pfl.product_performance(t.lines())


@query(
    "performance_segments",
    "PFL-1 SRT-2",
    f"""{_PERF}
, u AS ((SELECT 'top' seg, * FROM pq ORDER BY tr DESC, product_id LIMIT 10) UNION ALL (SELECT 'under', * FROM pq ORDER BY tr, product_id DESC LIMIT 10)
  UNION ALL (SELECT 'star', * FROM pq ORDER BY star DESC, product_id LIMIT 5))
SELECT seg AS segment, product_id, {q('tr')} AS total_revenue, {q('av')} AS avg_daily_sales, {q('star')} AS star_score FROM u""",
)
def performance_segments(t):
    return pfl.performance_segments(pfl.product_performance(t.lines()))


@query(
    "portfolio_overview",
    "PFL-3 AGG-12",
    f"""{_PERF}
, g AS (SELECT count(*) n, sum(tr) tr, sum(sh*sh)*10000 ci, max(sh) mx, avg(av) av FROM pq)
SELECT n AS products, {q('tr')} AS total_revenue, {q('ci')} AS concentration_index, {q('mx')} AS largest_share, {q('av')} AS mean_daily_sales,
  CASE WHEN ci>=2500 THEN 'high' WHEN ci>=1500 THEN 'moderate' ELSE 'low' END AS concentration FROM g""",
)
def portfolio_overview(t):
    return pfl.portfolio_overview(pfl.product_performance(t.lines()))


@query(
    "category_portfolio",
    "CAT-6 WIN-2",
    f"""
, m AS (SELECT first_category, count(DISTINCT product_id) tp, sum(units_sold)::BIGINT tu, sum(units_sold)*25.0::DOUBLE tr, stddev_samp(units_sold::DOUBLE) sd,
   {MEAN('units_sold', 'sale_date>=(SELECT d FROM ref)-30')} nw, {MEAN('units_sold', 'sale_date<=(SELECT d FROM ref)-30')} od
  FROM sales WHERE sale_date>=(SELECT d FROM ref)-90 GROUP BY 1 HAVING count(*)>=30),
g AS (SELECT *, tr/sum(tr) OVER () sh, coalesce(CASE WHEN od>0 THEN (nw-od)/od ELSE 0 END,0) gr, ((100-least(50,coalesce(sd,0)*10))+least(50,tu/100))/2 pr FROM m)
SELECT first_category, tp AS total_products, tu AS total_units, {q('tr')} AS total_revenue, {q('sh')} AS market_share, {q('gr')} AS growth_rate, {q('pr')} AS profitability,
  CASE WHEN sh>0.15 THEN 'market_leader' WHEN sh>0.1 THEN 'strong_player' WHEN sh>0.05 THEN 'moderate_player' ELSE 'niche_player' END AS strength,
  CASE WHEN gr>0.1 AND sh>0.1 THEN 'invest_and_expand' WHEN gr>0.05 THEN 'maintain_and_grow' WHEN gr<-0.1 THEN 'evaluate_and_optimize' ELSE 'monitor_closely' END AS recommendation FROM g""",
)
def category_portfolio(t):
    return pfl.category_portfolio(t.sales(geo=False, since=t.day(90)), t.as_of)


# ---- categories --------------------------------------------------------------------------------

_CD = """
, cd AS (SELECT first_category, sale_date, sum(sale_amount) a, bool_or(activity_flag) pf, bool_or(holiday_flag) hf FROM sales GROUP BY 1,2)"""


def _daily(t):
    return t.daily("first_category", geo=False)


@query(
    "category_performance",
    "CAT-1 WIN-11",
    f"""{_CD}
, r AS (SELECT *, row_number() OVER (PARTITION BY first_category ORDER BY sale_date) up, row_number() OVER (PARTITION BY first_category ORDER BY sale_date DESC) dn FROM cd),
g AS (SELECT first_category, sum(a) ts, {MEAN('a')} av, stddev_samp(a::DOUBLE)/{MEAN('a')} vo, count(*) n, {MEAN('a', 'up<=30')} f, {MEAN('a', 'dn<=30')} l, {MEAN('a', 'pf')} p, {MEAN('a', 'NOT pf')} rg FROM r GROUP BY 1)
SELECT first_category, {q('ts')} AS total_sales, {q('av')} AS avg_daily_sales, {q('vo')} AS volatility, n AS data_points, {q('CASE WHEN n>30 THEN (l-f)/f*100 ELSE 0 END')} AS growth_pct,
  {q('ts::DOUBLE/(sum(ts) OVER ())::DOUBLE*100')} AS share_pct, {q('(p-rg)/rg*100')} AS promo_uplift_pct FROM g""",
)
def category_performance(t):
    return cat.category_performance(_daily(t))


@query(
    "category_performance_short",
    "CAT-2 WIN-11",
    f"""{_CD}
, r AS (SELECT *, row_number() OVER (PARTITION BY first_category ORDER BY sale_date) up, row_number() OVER (PARTITION BY first_category ORDER BY sale_date DESC) dn FROM cd),
g AS (SELECT first_category, sum(a) ts, {MEAN('a')} av, {MEAN('a', 'up<=10')} f, {MEAN('a', 'dn<=10')} l FROM r GROUP BY 1)
SELECT first_category, {q('ts')} AS total_sales, {q('av')} AS avg_daily_sales, {q('(l-f)/f*100')} AS growth_pct, {q('ts::DOUBLE/(sum(ts) OVER ())::DOUBLE*100')} AS share_pct FROM g""",
)
def category_performance_short(t):
    out = cat.category_performance(_daily(t), edge=10)
    return out.select("first_category", "total_sales", "avg_daily_sales", "growth_pct", "share_pct")


@query(
    "monthly_sales_index",
    "CAT-2",
    f"""
, m AS (SELECT month(sale_date) m, sum(sale_amount)::DOUBLE v FROM lines GROUP BY 1), b AS (SELECT arg_min(v, m) b FROM m),
f AS (SELECT i.i::INT AS month, (SELECT arg_max(v, m) FROM m WHERE m<=i.i) v FROM range(1,13) i(i))
SELECT month, {q('coalesce(v/(SELECT b FROM b)*100, 100)')} AS sales_index FROM f""",
)
def monthly_sales_index(t):
    return cat.monthly_index(t.lines())


@query(
    "seasonality_pattern",
    "CAT-2 AGG-10",
    f"""
, m AS (SELECT first_category, month(sale_date) m, {MEAN('sale_amount')} a FROM sales GROUP BY 1,2),
g AS (SELECT first_category, arg_max(m,a)::INT pk, arg_min(m,a)::INT lo, (max(a)-min(a))/min(a) st FROM m GROUP BY 1)
SELECT first_category, pk AS peak_month, lo AS low_month, {q('st')} AS strength, CASE WHEN st<=0.3 THEN 'stable_year_round' WHEN pk IN (11,12,1) THEN 'holiday_driven' WHEN pk IN (6,7,8) THEN 'summer_peak'
  WHEN pk IN (3,4,5) THEN 'spring_driven' ELSE 'irregular' END AS pattern FROM g""",
)
def seasonality_pattern(t):
    return cat.seasonality_pattern(t.sales(geo=False))


@query(
    "market_position",
    "CAT-3",
    f"""
, g AS (SELECT first_category, sum(sale_amount) ts, sum(sale_amount) FILTER (WHERE sale_date>=(SELECT d FROM ref)-90) nw,
   sum(sale_amount) FILTER (WHERE sale_date>=(SELECT d FROM ref)-180 AND sale_date<(SELECT d FROM ref)-90) od FROM sales GROUP BY 1),
s AS (SELECT *, ts::DOUBLE/(sum(ts) OVER ())::DOUBLE*100 sh FROM g)
SELECT first_category, {q('ts')} AS total_sales, {q('coalesce((nw-od)::DOUBLE/od::DOUBLE*100,0)')} AS growth_pct, {q('sh')} AS share_pct,
  CASE WHEN sh>30 THEN 'Dominant' WHEN sh>20 THEN 'Strong' WHEN sh>10 THEN 'Moderate' ELSE 'Weak' END AS position FROM s""",
)
def market_position(t):
    return cat.market_position(t.sales(geo=False), t.as_of)


_ASSORT = f"""
, g AS (SELECT product_id, sum(sale_amount)::DOUBLE ts, {MEAN('sale_amount')} av, count(*) n FROM lines GROUP BY 1),
k AS (SELECT quantile_cont(av,0.5) am, quantile_cont(av,0.2) a2, quantile_cont(n::DOUBLE,0.5) nm, quantile_cont(ts,0.1) t1, count(*) c FROM g),
ad AS (SELECT product_id, ts, av, n, (rank() OVER (ORDER BY ts DESC))<=floor(c*0.2) tf, av>am AND n<nm ia, ts<t1 AND av<a2 ir FROM g, k)"""


@query(
    "assortment_advice",
    "CAT-4 AGG-8",
    f"""{_ASSORT}
SELECT product_id, {q('ts')} AS total_sales, {q('av')} AS avg_sales, n AS transactions, tf AS is_top_fifth, ia AS is_addition, ir AS is_removal FROM ad""",
)
def assortment_advice(t):
    return cat.assortment_advice(t.lines())


@query(
    "assortment_efficiency",
    "CAT-4",
    f"""{_ASSORT}
SELECT count(*) AS products, {q('sum(ts) FILTER (WHERE tf)/sum(ts)*100')} AS efficiency_pct, count(*) FILTER (WHERE ia) AS additions, count(*) FILTER (WHERE ir) AS removals,
  {q('coalesce(sum(ts) FILTER (WHERE ia),0)*1.5')} AS revenue_potential FROM ad""",
)
def assortment_efficiency(t):
    return cat.assortment_efficiency(cat.assortment_advice(t.lines()))


@query(
    "phase_indexes",
    "CAT-5",
    f"""{_CD}
, o AS (SELECT first_category, {MEAN('a')} o FROM cd GROUP BY 1),
x AS (SELECT first_category, 'month' kind, month(sale_date)::INT phase, {MEAN('a')} m FROM cd GROUP BY 1,3 UNION ALL SELECT first_category, 'weekday', (isodow(sale_date)-1)::INT, {MEAN('a')} FROM cd GROUP BY 1,3)
SELECT first_category, kind, phase, {q('m/o')} AS "index" FROM x JOIN o USING (first_category)""",
)
def phase_indexes(t):
    return cat.phase_indexes(_daily(t))


_DEC = """
, cd AS (SELECT first_category, sale_date, sum(sale_amount) a FROM sales GROUP BY 1,2),
g AS (SELECT first_category, unnest(generate_series(min(sale_date), max(sale_date), INTERVAL 1 DAY))::DATE AS sale_date FROM cd GROUP BY 1),
ds AS (SELECT g.first_category, g.sale_date, coalesce(a,0)::DOUBLE a FROM g LEFT JOIN cd USING (first_category, sale_date)),
tr AS (SELECT *, CASE WHEN count(*) OVER w=7 THEN sum(a::DECIMAL(18,2)) OVER w::DOUBLE/7 END t, (row_number() OVER (PARTITION BY first_category ORDER BY sale_date)-1)%7 ph FROM ds
  WINDOW w AS (PARTITION BY first_category ORDER BY sale_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
ph AS (SELECT first_category, ph, avg(a-t) pm FROM tr GROUP BY 1,2), pm AS (SELECT first_category, avg(pm) mm FROM ph GROUP BY 1),
dc AS (SELECT tr.first_category, sale_date, a, t, pm-mm s, a-t-(pm-mm) rs FROM tr JOIN ph ON ph.first_category=tr.first_category AND ph.ph=tr.ph JOIN pm ON pm.first_category=tr.first_category)"""


def _dense(t):
    d = _daily(t).select("first_category", "sale_date", "sale_amount")
    return dense_series(d, ["first_category"], ["sale_amount"])


@query(
    "seasonal_decomposition",
    "CAT-5",
    f"""{_DEC}
SELECT first_category, sale_date::VARCHAR AS sale_date, {q('a', 2)} AS sale_amount, {q('t', 2)} AS trend, {q('s', 2)} AS seasonal, {q('rs', 2)} AS residual FROM dc""",
    digits=2,
)
def seasonal_decomposition(t):
    return cat.decompose(_dense(t))


@query(
    "seasonality_strength",
    "CAT-5 CMB-7",
    f"""{_DEC}
SELECT first_category, count(*) AS days, {q('stddev_pop(s)/stddev_pop(a)')} AS seasonal_strength, {q('stddev_pop(t)/stddev_pop(a)')} AS trend_strength FROM dc GROUP BY 1""",
)
def seasonality_strength(t):
    return cat.seasonality_strength(cat.decompose(_dense(t)))


@query(
    "seasonality_lookup",
    "CMB-6",
    f"""{_CD}
, o AS (SELECT first_category, {MEAN('a')} o FROM cd GROUP BY 1), mo AS (SELECT first_category, month(sale_date) p, {MEAN('a')} m FROM cd GROUP BY 1,2),
wk AS (SELECT first_category, isodow(sale_date) p, {MEAN('a')} m FROM cd GROUP BY 1,2),
h AS (SELECT first_category, coalesce(({MEAN('a', 'hf')}-{MEAN('a', 'NOT hf')})/{MEAN('a', 'NOT hf')},0) i FROM cd GROUP BY 1)
SELECT cd.first_category, cd.sale_date::VARCHAR AS sale_date, {q('a')} AS sale_amount, {q('mo.m/o')} AS monthly_seasonality, {q('wk.m/o')} AS weekly_seasonality, {q('i*hf::INT')} AS expected_holiday_impact
FROM cd JOIN o ON o.first_category=cd.first_category JOIN mo ON mo.first_category=cd.first_category AND mo.p=month(cd.sale_date)
JOIN wk ON wk.first_category=cd.first_category AND wk.p=isodow(cd.sale_date) JOIN h ON h.first_category=cd.first_category""",
)
def seasonality_lookup(t):
    out = cat.seasonality_lookup(_daily(t))
    return out.select(
        "first_category", "sale_date", "sale_amount", "monthly_seasonality", "weekly_seasonality", "expected_holiday_impact"
    )
