"""Steps that once grew faster than their input: their results, and what they no longer do."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from aislecast import session
from aislecast.operators import correlation, features, forecast, relational, uplift
from aislecast.plans import clustering
from aislecast.schemas import RAW
from aislecast.sources.adapter import RetailTables

D0 = dt.date(2024, 1, 1)
PROMOTION = "promotion_id string, store_id long, product_id long, start_date date, end_date date, promotion_type string, discount_percentage int"


def plan_of(df, capsys) -> str:
    df.explain()
    return capsys.readouterr().out


def day(i):
    return D0 + dt.timedelta(days=i)


def test_promotion_days_are_not_sent_whole_to_all_tasks(spark, capsys):
    promos = spark.createDataFrame(
        [("S1", 1, None, day(0), day(3), "a", 5), ("P7", None, 7, day(2), day(4), "b", 10), ("SP", 2, 7, day(3), day(3), "c", 20), ("R", None, None, day(6), day(6), "d", 1)],
        PROMOTION,
    )
    sales = spark.createDataFrame([(day(i), s, p) for i in range(8) for s in (1, 2) for p in (7, 8)], "sale_date date, store_id long, product_id long")
    off = relational.rows_off_promotion(sales, promos)
    assert "Broadcast" not in plan_of(off, capsys)
    kept = {(r.sale_date, r.store_id, r.product_id) for r in off.collect()}
    assert kept == {(day(i), s, p) for i in range(8) for s in (1, 2) for p in (7, 8) if p == 8 or i not in (2, 3, 4)}
    won = relational.apply_promotions(sales, promos)
    assert plan_of(won, capsys).count("BroadcastHashJoin") <= 1  # the promotions of all: a row a day
    got = {(r.sale_date, r.store_id, r.product_id): r.promotion_id for r in won.collect()}
    assert len(got) == 32
    for (d, s, p), name in got.items():
        i = (d - D0).days
        fits = [x for x, ok in (("SP", s == 2 and p == 7 and i == 3), ("P7", p == 7 and 2 <= i <= 4), ("S1", s == 1 and i <= 3), ("R", i == 6)) if ok]
        assert name == (fits[0] if fits else None)


def test_cells_of_few_entities_meet_without_blocks(spark, capsys):
    rnd = random.Random(3)
    cells = [(f"{i:02d}", c, float(rnd.randint(1, 9)), float(rnd.randint(1, 9))) for c in range(60) for i in rnd.sample(range(40), 4 if c else 30)]
    cells += [("aa", None, 2.0, 3.0), ("bb", None, 5.0, 7.0)]
    want = defaultdict(lambda: [0.0, 0.0, 0.0])
    for i, c, x, y in cells:
        for j, e, v, w in cells:
            if c == e and i < j:
                for k, z in enumerate((x * v, x * w, y * v)):
                    want[i, j][k] += z
    df = spark.createDataFrame(cells, "i string, cell long, n double, s double")
    for few in (1, 4, 64):
        sums = correlation.cooccurrence_sums(df, "i", ["cell"], "n", "s", block=7, chunk=8, few=few)
        got = {(r.item_a, r.item_b): [r.xx, r.xy, r.yx] for r in sums.collect()}
        assert got == dict(want), few
    assert "FlatMapGroupsInPandas" not in plan_of(sums, capsys)  # no row is copied to blocks


def test_store_day_pairs_of_many_products_make_no_blocks(spark, capsys):
    rows = [(day(i % 50), i % 30, i, 1.0 + i % 3) for i in range(3000)] + [(day(i % 50), i % 30, i + 7500, 2.0) for i in range(0, 3000, 7)]
    df = spark.createDataFrame(rows, "sale_date date, store_id long, product_id long, v double")
    pairs = correlation.cell_correlations(df, "product_id", ["sale_date", "store_id"], "v", 0.3)
    assert "FlatMapGroupsInPandas" not in plan_of(pairs, capsys)
    assert pairs.filter(F.col("r") > 0.99).count() == pairs.count() > 3000


def test_product_correlations_return_every_pair(spark):
    rows = [(day(d), p, 1.0 + (d % 3 == 0) * 4 + (p + d) % 2) for p in range(30) for d in range(12)]
    df = spark.createDataFrame(rows, "sale_date date, product_id long, sale_amount double")
    x = np.array([[v for _, q, v in rows if q == p] for p in range(30)])
    r = np.corrcoef(x)
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if abs(r[i, j]) >= 0.3}
    got = [(p.item_a, p.item_b) for p in correlation.product_correlations(df).collect()]
    assert len(got) == len(want) > 30 * 10 / 2 and set(got) == want


def test_rows_of_the_uplift_models_are_worked_out_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    names = ["sale_date", "store_id", "product_id", "first_category", *uplift.NUMERIC, "label"]
    data = [(day(i), i % 4, i % 7, f"c{i % 2}", *[float(i * k % 11) for k in range(1, 1 + len(uplift.NUMERIC))], float(i)) for i in range(60)]
    rows = spark.createDataFrame(data, names).withColumn("label", counted("label"))
    got = uplift.uplift_scores(rows, ("linear", "elastic_net")).collect()
    assert [r.model for r in got] == ["linear", "elastic_net"] and all(r.rows == got[0].rows > 0 for r in got)
    assert read.value == 60


def _line(i):
    return {"l_orderkey": i, "l_partkey": i % 7 + 1, "l_suppkey": i % 3 + 1, "l_quantity": 1.0, "l_extendedprice": 2.5, "l_discount": 0.0, "l_returnflag": "N", "l_shipdate": dt.datetime(2024, 1, 1 + i % 5)}


def test_a_task_reads_a_bounded_share_of_any_table(spark, tmp_path):
    rows = [tuple(_line(i).get(f.split()[0]) for f in RAW["lineitem"].split(",")) for i in range(40)]
    spark.createDataFrame(rows, RAW["lineitem"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    for key in session.SHARES:
        spark.conf.unset(key)
    t = RetailTables(spark, str(tmp_path))
    assert {k: spark.conf.get(k) for k in session.SHARES} == session.SHARES
    spark.conf.set(session.INITIAL, "999")  # left by a larger table
    lines = t.lines()
    assert spark.conf.get(session.INITIAL, None) is None  # a small table keeps the set number
    assert lines.agg(F.sum("units_sold")).first()[0] == 40


def test_shuffle_partitions_follow_the_scan(spark):
    cores, before = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        session.deal_shuffles(spark, 2 * cores)
        assert spark.conf.get(session.INITIAL, None) is None
        for scans in (100 * cores, 600 * cores):  # six times the table: six times the partitions, not six times their size
            session.deal_shuffles(spark, scans)
            assert int(spark.conf.get(session.INITIAL)) == session.PER_SCAN * scans > before
    finally:
        spark.conf.unset(session.INITIAL)


def test_few_model_rows_are_not_held_in_many_partitions(spark):
    cores = spark.sparkContext.defaultParallelism
    with forecast.cached(spark.range(1000).repartition(20 * cores)) as held:
        assert held.rdd.getNumPartitions() == 2 * cores
        assert sorted(r.id for r in held.collect()) == list(range(1000))
    with forecast.cached(spark.range(1000).repartition(2 * cores)) as held:
        assert held.rdd.getNumPartitions() == 2 * cores
    with forecast.cached(spark.range(0, 10 * cores * forecast.ROWS_HELD, 1, 20 * cores)) as held:  # many rows keep their share
        assert held.rdd.getNumPartitions() == 10 * cores


def test_sales_of_the_category_features_are_worked_out_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(v):
        read.add(1)
        return v

    data = [(day(i % 9), i % 4, i, f"c{i % 3}", float(i % 7), i % 5 / 100) for i in range(60)]
    sales = spark.createDataFrame(data, "sale_date date, store_id long, product_id long, first_category string, sale_amount double, discount double")
    got = features.category_features(sales.withColumn("product_id", counted("product_id"))).collect()
    assert sorted(r.product_id for r in got) == list(range(60)) and all(r.store_category_diversity == 3 and r.category_count == 20 for r in got)
    assert read.value == 60


def _tables(spark, folder):
    """Small tables of the given schemas: 3 stores in 2 cities, 12 products."""
    rows = {
        "region": [(0, "R")],
        "nation": [(0, "A", 0), (1, "B", 0)],
        "supplier": [(i, f"S{i}", i % 2, 1.0) for i in (1, 2, 3)],
        "part": [(i, f"P{i}", "b", f"t{i % 3}", i, 2.0) for i in range(1, 13)],
        "lineitem": [(i, i % 12 + 1, i % 3 + 1, 1, 1.0 + i % 4, 2.0 + i * i % 17, i % 11 / 100, 0.0, "N", "O", dt.datetime(2024, 1 + i % 11, 1 + i * 7 % 27)) for i in range(400)],
    }
    for name, data in rows.items():
        spark.createDataFrame(data, RAW[name]).write.parquet(f"{folder}/{name}.parquet")
    return RetailTables(spark, str(folder))


def test_weather_sensitivities_are_worked_out_once(spark, tmp_path, capsys):
    clusters = clustering.weather_sensitivity_clusters(_tables(spark, tmp_path))
    assert "lineitem" not in plan_of(clusters, capsys)  # the fit, the count and the result read the entity table
    assert sorted(r.product_id for r in clusters.collect()) == list(range(1, 13))
