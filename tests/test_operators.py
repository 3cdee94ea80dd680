"""Operators on hand-made frames: edge cases, invariants and brute-force comparisons."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aislecast.functions import arrays, codec, geo
from aislecast.functions.core import clamp, ladder, mean_of, ratio, safe_corr, slope_of, stable_bucket
from aislecast.operators import cleaning, clustering, correlation, forecast, inventory, ranking, relational, series, uplift
from aislecast.sources import checks, sinks

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def test_ratio_and_statistics_of_degenerate_input(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (1, 5.0, 2.0), (2, 1.0, 1.0), (3, None, 1.0)], "k int, x double, y double")
    rows = {r.k: r for r in df.groupBy("k").agg(safe_corr("x", "y").alias("r"), slope_of("y", "x").alias("s"), mean_of("x").alias("m")).collect()}
    assert rows[1].r is None and rows[1].s is None
    assert rows[2].r is None and rows[3].m is None
    assert df.select(ratio(F.lit(1), F.lit(0)).alias("z")).first().z is None
    assert df.filter("k = 99").agg(mean_of("x").alias("m")).first().m is None


def test_ladder_and_clamp(spark):
    df = spark.createDataFrame([(0.9,), (0.5,), (0.1,), (None,)], "x double")
    out = [r[0] for r in df.select(ladder("x", [(0.8, "a"), (0.4, "b")], "c")).collect()]
    assert out == ["a", "b", "c", "c"]
    assert df.select(clamp("x", 0.2, 0.6)).first()[0] == 0.6


def test_hour_arrays(spark):
    rows = [(1, [5.0, 1.0, 0.0]), (2, [2.0, 2.0, 1.0]), (3, [0.0, 0.0, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "k int, a array<double>")
    out = {r.k: r for r in df.select("k", arrays.peak_hour(F.col("a")).alias("p"), arrays.zero_share(F.col("a")).alias("z")).collect()}
    assert out[1].p == 0 and out[2].p == 0 and out[3].p == 0 and out[4].p is None
    assert out[3].z == 1.0 and out[4].z == 0.0 and out[1].z == pytest.approx(1 / 3)
    bad = spark.createDataFrame([("[1,2]",), ("oops",), (None,)], "t string").select(F.size(arrays.parse_hours(F.col("t"))).alias("n"))
    assert [r.n for r in bad.collect()] == [2, 0, 0]


def test_codec_round_trip_and_defaults(spark):
    df = spark.createDataFrame([(0, 0), (99, 99), (8, 2)], "c int, g int")
    real = codec.decode_amount(F.lit(2.0), F.col("c"), F.col("g"))
    out = df.select(real.alias("r"), codec.encode_amount(real, F.col("c"), F.col("g")).alias("e")).collect()
    assert out[0].r == pytest.approx(2 * 20 * 1.2 * 1.25)
    assert out[1].r == pytest.approx(40.0)
    assert all(r.e == pytest.approx(2.0) for r in out)


def test_distance_and_bucket(spark):
    r = spark.range(1).select(
        geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km"), stable_bucket(F.lit(1), F.lit(2)).alias("b")
    ).first()
    assert r.km == pytest.approx(111.19, abs=0.01) and 0 <= r.b < 100


def test_longest_dry_spell(spark):
    rain = [0, 0, 1, 0, 0, 0, 2]
    df = spark.createDataFrame([(1, day(i), float(p)) for i, p in enumerate(rain)] + [(2, day(0), 3.0)], "c int, d date, p double")
    out = {r.c: r.longest_run for r in series.longest_run(df, ["c"], F.col("p") == 0, "d").collect()}
    assert out == {1: 3, 2: 0}


def test_rolling_needs_a_full_frame(spark):
    df = spark.createDataFrame([(1, day(i), i + 1) for i in range(8)], "k int, sale_date date, u bigint")
    out = series.lag_roll_features(df, ["k"], "u", lags=(1, 7), rolls=(7,)).orderBy("sale_date").collect()
    assert out[5].roll_mean_7 is None and out[6].roll_mean_7 == 4.0 and out[7].lag_7 == 1
    assert out[0].lag_1 is None


def test_holiday_distance_defaults(spark):
    days = spark.createDataFrame([(day(i),) for i in range(5)], "sale_date date")
    hol = spark.createDataFrame([(day(2), "x")], "date date, holiday_name string")
    out = {r.sale_date: (r.days_since_holiday, r.days_until_holiday) for r in relational.holiday_distance(days, hol).collect()}
    assert out[day(0)] == (365, 2) and out[day(2)] == (0, 365) and out[day(4)] == (2, 365)


def test_promotion_interval_join_latest_start_wins(spark):
    sales = spark.createDataFrame([(day(i), s, 1) for i in range(6) for s in (1, 2)], "sale_date date, store_id bigint, product_id bigint")
    promos = spark.createDataFrame(
        [("A", None, None, day(0), day(3), "x", 5), ("B", 1, None, day(2), day(4), "y", 10), ("C", 1, 1, day(1), day(1), "z", 15)],
        "promotion_id string, store_id bigint, product_id bigint, start_date date, end_date date, promotion_type string, discount_percentage int",
    )
    out = {(r.sale_date, r.store_id): r.promotion_id for r in relational.apply_promotions(sales, promos).collect()}
    assert len(out) == 12
    assert [out[day(i), 1] for i in range(6)] == ["A", "C", "B", "B", "B", None]
    assert [out[day(i), 2] for i in range(6)] == ["A", "A", "A", "A", None, None]


def test_exact_quantiles_equal_numpy_under_a_hot_value(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(700, 3.0), rng.normal(size=1301)])
    g = np.where(np.arange(len(x)) % 3 == 0, 0, 1)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x}))
    probs = {"a": 0.05, "b": 0.5, "c": 0.99}
    one = ranking.exact_quantiles(df, "x", probs).first()
    for n, p in probs.items():
        assert one[n] == pytest.approx(np.quantile(x, p), abs=1e-12)
    for r in ranking.exact_quantiles(df, "x", probs, ["g"]).collect():
        assert r.b == pytest.approx(np.quantile(x[g == r.g], 0.5), abs=1e-12)
    two = ranking.column_quantiles(df, {"x": {"m": 0.5}, "g": {"q": 0.25}}).first()
    assert two.m == pytest.approx(np.quantile(x, 0.5)) and two.q == np.quantile(g, 0.25)


def test_global_and_percent_rank_equal_pandas(spark):
    rng = np.random.default_rng(2)
    s = pd.Series(np.concatenate([rng.integers(0, 50, 400), np.full(200, 7)])).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(s)), "v": s}))
    got = ranking.with_global_rank(df, "v").toPandas().set_index("i")["rank"].sort_index()
    assert (got.to_numpy() == s.rank(method="min", ascending=False).astype(int).to_numpy()).all()
    pct = ranking.with_percent_rank(df, "v").toPandas().set_index("i")["pct_rank"].sort_index()
    assert np.allclose(pct, s.rank(pct=True))


def test_grid_correlations_equal_pandas_over_several_blocks(spark):
    rng = np.random.default_rng(3)
    dense = rng.integers(0, 4, size=(20, 37)).astype(float)
    dense[:, 5] = dense[:, 6]
    rows = [(f"p{j:02d}", day(i), float(dense[i, j])) for i in range(20) for j in range(37) if dense[i, j] > 0]
    df = spark.createDataFrame(rows, "item string, d date, x double")
    want = pd.DataFrame(dense, columns=[f"p{j:02d}" for j in range(37)]).corr()
    got = correlation.grid_correlations(df, "item", "d", "x", 0.3, block=8).collect()
    pairs = {(r.item_a, r.item_b): r.r for r in got}
    names = list(want)
    expect = {(a, b): want.loc[a, b] for i, a in enumerate(names) for b in names[i + 1 :] if abs(want.loc[a, b]) >= 0.3}
    assert pairs.keys() == expect.keys() and len(got) == len(pairs)
    assert all(pairs[k] == pytest.approx(v) for k, v in expect.items())


def test_cooccurrence_sums_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = sorted({(f"c{rng.integers(9)}", int(rng.integers(60))) for _ in range(200)})
    data = [(c, cell, float(i % 5 + 1), float(i % 7 + 1)) for i, (c, cell) in enumerate(rows)]
    df = spark.createDataFrame(data, "c string, cell int, n double, s double")
    got = {(r.item_a, r.item_b): (r.xx, r.xy, r.yx) for r in correlation.cooccurrence_sums(df, "c", ["cell"], "n", "s", block=4, chunk=16).collect()}
    want = {}
    for a, ca, na, sa in data:
        for b, cb, nb, sb in data:
            if a < b and ca == cb:
                x = want.get((a, b), (0, 0, 0))
                want[a, b] = (x[0] + na * nb, x[1] + na * sb, x[2] + sa * nb)
    assert got == want


def test_p_value_known_points(spark):
    df = spark.createDataFrame([(0.0, 10), (0.632, 10), (1.0, 5), (0.5, 2)], "r double, n int")
    out = [r[0] for r in df.select(correlation.p_value(F.col("r"), F.col("n"))).collect()]
    assert out[0] == pytest.approx(1.0) and out[1] == pytest.approx(0.05, abs=2e-3) and out[2] == pytest.approx(0.0, abs=1e-12)
    assert out[3] is None


def _transfer_frame(spark):
    sales = [(day(0), s, 1, u, lvl) for s, u, lvl in ((1, 2, 100), (2, 2, 100), (3, 30, 10), (4, 40, 5), (5, 30, 10))]
    df = spark.createDataFrame(sales, "sale_date date, store_id bigint, product_id bigint, units_sold bigint, stock_level bigint")
    where = [(1, 0.0, 0.0), (2, 0.0, 0.5), (3, 0.0, 1.0), (4, 0.5, 0.5), (5, 40.0, 40.0)]
    store = spark.createDataFrame([(s, 1, a, b) for s, a, b in where], "store_id bigint, city_id int, latitude double, longitude double")
    return inventory.inventory_status(df, store, min_rows=1)


def test_transfers_equal_all_pairs(spark):
    status = _transfer_frame(spark)
    rows = {r.store_id: r for r in status.collect()}
    got = {(r.source_store_id, r.target_store_id): r for r in inventory.transfer_opportunities(status).collect()}
    want = set()
    for a in rows.values():
        for b in rows.values():
            if a.stock_status == "overstock" and a.days_of_inventory > 30 and b.stock_status == "stockout_risk" and b.days_of_inventory < 3:
                h = math.sin(math.radians(b.latitude - a.latitude) / 2) ** 2 + math.cos(math.radians(a.latitude)) * math.cos(
                    math.radians(b.latitude)
                ) * math.sin(math.radians(b.longitude - a.longitude) / 2) ** 2
                if 0.5 * 6371 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) <= 100:
                    want.add((a.store_id, b.store_id))
    assert set(got) == want and len(want) == 4
    assert all(0 <= r.optimization_score <= 100 and r.quantity >= 5 for r in got.values())


def test_allocation_sums_to_hundred(spark):
    rows = [(s, "a", day(i), float(s * 10 + i), i % 3) for s in (1, 2, 3) for i in range(12)]
    df = spark.createDataFrame(rows, "store_id bigint, k string, sale_date date, sale_amount double, stock_hours int")
    out = inventory.allocate_across_stores(df, "k").agg(F.sum("allocation_pct")).first()[0]
    assert out == pytest.approx(100.0)


def test_imputation_leaves_gaps_without_any_value(spark):
    rows = [(1, 10.0), (1, None), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "city_id int, avg_temperature double")
    out = cleaning.impute(df, columns=["avg_temperature"]).orderBy("city_id", "avg_temperature").collect()
    assert [r.avg_temperature for r in out] == [10.0, 10.0, None, None]


def test_density_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal((0, 0), 0.2, (40, 2)), rng.normal((5, 5), 0.2, (40, 2)), [[20.0, -20.0]]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(pts)), "x": pts[:, 0], "y": pts[:, 1]}))
    eps, minimum = 0.3, 4
    got = {r.id: (r.cluster, r.is_core) for r in clustering.density_clusters(df, "id", ["x", "y"], eps, minimum, block=20).collect()}
    z = (pts - pts.mean(0)) / pts.std(0, ddof=1)
    near = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= minimum
    label = {i: i for i in np.flatnonzero(core)}
    for _ in range(len(pts)):
        for i in label:
            label[i] = min(label[j] for j in np.flatnonzero(near[i] & core))
    for i in range(len(pts)):
        assert got[i][1] == core[i]
        if core[i]:
            assert got[i][0] == label[i]
        else:
            reach = {label[j] for j in np.flatnonzero(near[i] & core)}
            assert got[i][0] == (min(reach) if reach else -1)


def test_cluster_quality_equals_numpy_and_is_repeatable(spark):
    rng = np.random.default_rng(6)
    pts = np.concatenate([rng.normal(0, 1, (50, 2)), rng.normal(8, 1, (50, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(100), "x": pts[:, 0], "y": pts[:, 1]}))
    a = clustering.kmeans_clusters(df, ["x", "y"], 2)
    pdf = a.select("id", "x", "y", "cluster").toPandas()
    b = clustering.kmeans_clusters(df, ["x", "y"], 2).select("id", "cluster").toPandas()
    assert (pdf.sort_values("id")["cluster"].to_numpy() == b.sort_values("id")["cluster"].to_numpy()).all()
    xy, total = pdf[["x", "y"]].to_numpy(), pdf[["x", "y"]].to_numpy().mean(0)
    within = between = 0.0
    for c in (0, 1):
        part = xy[pdf["cluster"] == c]
        within += ((part - part.mean(0)) ** 2).sum()
        between += len(part) * ((part.mean(0) - total) ** 2).sum()
    q = clustering.cluster_quality(a, ["x", "y"]).first()
    assert q.calinski_harabasz == pytest.approx(between / (within / 98)) and q.inertia == pytest.approx(within)


def _series(spark, n=120):
    rows = [(k, day(i), 100.0 + 10 * k + 20 * math.sin(2 * math.pi * i / 7) + 0.1 * i) for k in (1, 2) for i in range(n)]
    return spark.createDataFrame(rows, "k int, sale_date date, sale_amount double")


def test_forecasts_are_ordered_and_better_than_naive(spark):
    df = _series(spark)
    past = df.filter(F.col("sale_date") < F.lit(day(106)))
    naive = forecast.naive_forecast(past, ["k"], 14)
    fit = forecast.seasonal_forecast(past, ["k"], 14)
    actual = df.withColumnRenamed("sale_date", "date")
    err = lambda f: f.join(actual, ["k", "date"]).agg(F.avg(F.abs(F.col("forecast") - F.col("sale_amount")))).first()[0]
    for f in (naive, fit):
        assert f.count() == 28
        assert f.filter("lower > forecast OR forecast > upper OR lower < 0").count() == 0
    assert err(fit) < err(naive) / 2
    again = forecast.seasonal_forecast(past, ["k"], 14)
    assert sorted(map(tuple, fit.collect())) == sorted(map(tuple, again.collect()))


def test_short_series_give_no_model_forecast(spark):
    assert forecast.seasonal_forecast(_series(spark, 5), ["k"], 7).count() == 0


def test_ensemble_weights_must_sum_to_one(spark):
    f = forecast.naive_forecast(_series(spark), ["k"], 3)
    with pytest.raises(ValueError):
        forecast.ensemble({"a": (f, 0.5), "b": (f, 0.6)}, ["k"])
    mixed = forecast.ensemble({"a": (f, 0.4), "b": (f, 0.6)}, ["k"])
    j = mixed.join(f.withColumnRenamed("forecast", "f0").select("k", "date", "f0"), ["k", "date"])
    assert j.filter(F.abs(F.col("forecast") - F.col("f0")) > 1e-9).count() == 0


def test_upsert_and_checks(spark):
    old = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    new = spark.createDataFrame([(2, 21), (3, 30)], "k int, v int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, 10), (2, 21), (3, 30)]
    twice = old.unionByName(old)
    assert checks.duplicate_keys(twice, ["k"], "dup").count() == 2
    assert checks.missing_reference(new, "k", old, "k", "fk").collect()[0].key == "3"
    assert checks.out_of_range(new, "v", 0, 25, "range").count() == 1


def test_dense_series_fills_inner_gaps_only(spark):
    df = spark.createDataFrame([(1, day(0), 5), (1, day(3), 7)], "k int, sale_date date, u bigint")
    out = relational.dense_series(df, ["k"], ["u"]).orderBy("sale_date").collect()
    assert [r.u for r in out] == [5, 0, 0, 7]


def test_default_radius_of_density_clusters(spark):
    rng = np.random.default_rng(8)
    pts = np.concatenate([rng.normal((0, 0), 0.3, (30, 2)), rng.normal((4, 4), 0.5, (25, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(pts)), "x": pts[:, 0], "y": pts[:, 1]}))
    core, radius = clustering.density_core(df, "id", ["x", "y"], block=20)
    z = (pts - pts.mean(0)) / pts.std(0, ddof=1)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    assert radius == pytest.approx(np.quantile(np.sort(d, axis=1)[:, 3], 0.75))  # the point itself is the first of four
    assert {r.id: r.n for r in core.collect()} == dict(enumerate((d <= radius).sum(1).tolist()))


def test_cell_correlations_equal_numpy_with_negative_pairs(spark):
    rng = np.random.default_rng(3)
    days, items = 40, 12
    x = np.zeros((items, days))
    for i in range(items):
        on = np.arange(days) % 2 == i % 2 if i < 6 else rng.random(days) < 0.4
        x[i, on] = rng.integers(5, 9, on.sum()) if i < 6 else rng.integers(1, 9, on.sum())
    rows = [(int(i), day(int(j)), 1, float(x[i, j])) for i in range(items) for j in range(days) if x[i, j]]
    df = spark.createDataFrame(rows, "item long, sale_date date, store_id int, v double")
    r = np.corrcoef(x)
    want = {(i, j): r[i, j] for i in range(items) for j in range(i + 1, items) if abs(r[i, j]) >= 0.3}
    got = {(p.item_a, p.item_b): p.r for p in correlation.cell_correlations(df, "item", ["sale_date", "store_id"], "v", 0.3, block=5, chunk=7).collect()}
    assert got.keys() == want.keys() and min(want.values()) < -0.5
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    listed = {(p.item_a, p.item_b): p.r for p in correlation.correlations_with(df, [2, 9], "item", "v").collect()}
    assert listed.keys() == {k for k in want if 2 in k or 9 in k}
    assert all(listed[k] == pytest.approx(want[k]) for k in listed)


def test_forest_beats_the_mean_and_refuses_short_history(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, level in ((1, 100.0), (2, 300.0)):
        for i in range(220):
            promo = i % 9 == 0
            rows.append((k, day(i), level + 25 * (i % 7) + (40 if promo else 0) + float(rng.normal(0, 4)), 15.0 + i % 20, 50.0, 0.0, 0.2 if promo else 0.0, i % 50 == 0))
    rows += [(3, day(i), 5.0, 15.0, 50.0, 0.0, 0.0, False) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, sale_date date, sale_amount double, avg_temperature double, avg_humidity double, precpt double, discount double, holiday_flag boolean")
    inputs = forecast.forest_rows(df, ["k"])
    assert inputs.filter("k = 3").count() == 0
    mean, model = forecast.baseline_error(inputs).first(), forecast.forest_scores(inputs, trees=20, depth=8).first()
    assert model.rows == mean.rows and model.mae < mean.mae / 2
    ahead = forecast.forest_forecast(df, ["k"], 14, trees=20, depth=8)
    assert {r.k: r["count"] for r in ahead.groupBy("k").count().collect()} == {1: 14, 2: 14}
    assert ahead.filter("lower > forecast or forecast > upper or lower < 0").count() == 0


def test_targets_are_filtered_before_the_best_are_taken(spark):
    grid = spark.createDataFrame([(1, 0.1, 5.0, 9.0), (2, 0.1, 50.0, 1.0), (3, 0.1, 60.0, 0.5)], "k int, discount double, estimated_uplift double, estimated_roi double")
    assert [r.k for r in uplift.simulate_promotions(grid, ["k"], top=1, target_uplift=20.0).collect()] == [2]
