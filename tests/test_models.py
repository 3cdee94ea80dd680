"""Pair search, density clusters, tree tables, fold statistics and crowded transfers against brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from aislecast.operators import clustering, density, forecast, inventory, linearfolds, pairsearch, promotions, trees


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=int(i))


# ---- correlated pairs --------------------------------------------------------------------------


def grid(spark, x):
    rows = [(int(i), day(j), float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if x[i, j]]
    return spark.createDataFrame(rows, "item long, d date, v double")


def sparse_and_dense(seed=1):
    """Items that sell on one or two days, items of a weekly rhythm, copies, a constant and one that never sells again."""
    rng = np.random.default_rng(seed)
    x = np.zeros((130, 30))
    for i in range(90):
        x[i, rng.choice(30, rng.integers(1, 3), replace=False)] = rng.integers(1, 9)
    for i in range(90, 120):
        x[i] = 5 + 3 * np.sin(2 * np.pi * (np.arange(30) + i % 7) / 7) + rng.normal(0, 0.5, 30)
    x[120:129] = x[3]
    x[129] = 2.0
    return x


def brute(x, least=0.3):
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.corrcoef(x)
    return {(i, j): r[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if abs(r[i, j]) >= least}


@pytest.mark.parametrize("size,block", [(16, 4), (40, 16), (None, 256)])
def test_correlated_pairs_equal_brute_force(spark, size, block):
    x = sparse_and_dense()
    got = {(r.item_a, r.item_b): r.r for r in pairsearch.correlated_pairs(grid(spark, x), "item", "d", "v", 0.3, size, block).collect()}
    want = brute(x)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_strongest_partners_have_counts_of_all_links(spark):
    x = sparse_and_dense(2)
    links = {}
    for (i, j), r in brute(x).items():
        links.setdefault(i, []).append((-round(abs(r), 6), j, r))
        links.setdefault(j, []).append((-round(abs(r), 6), i, r))
    got = {}
    for r in pairsearch.strongest_partners(grid(spark, x), "item", "d", "v", 0.3, 4, 24, 8).collect():
        got.setdefault(r.item, []).append((r["rank"], r.other, r.n_links))
    assert got.keys() == links.keys()
    for i, found in links.items():
        assert sorted(got[i]) == [(n + 1, j, len(found)) for n, (_, j, _) in enumerate(sorted(found)[:4])]


def test_ranges_without_room_for_a_correlation_do_not_meet(spark):
    x = np.zeros((60, 12))
    for i in range(60):
        x[i, i // 5] = 1 + i % 3
    series, n = pairsearch._series(grid(spark, x), "item", "d", "v")
    ranges = pairsearch._ranges(series, n, 5)
    many = ranges.count()
    meeting = pairsearch.meeting_ranges(ranges, 0.3)
    assert len(meeting) < many * (many + 1) / 4
    z, _ = pairsearch._unit(12, [np.flatnonzero(r) for r in x], [r[r > 0] for r in x])
    bounds = pairsearch.Bounds([pairsearch._summary(z[s : s + 7]) for s in range(0, 60, 7)])
    for i in range(9):
        for j, top in enumerate(bounds.against(i, bounds)):
            assert np.abs(z[i * 7 : i * 7 + 7] @ z[j * 7 : j * 7 + 7].T).max() <= top + 1e-9


def test_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], "item long, d date, v double")
    assert pairsearch.correlated_pairs(empty, "item", "d", "v").count() == 0
    one = spark.createDataFrame([(1, day(0), 2.0), (2, day(1), None), (3, day(0), 0.0)], "item long, d date, v double")
    assert pairsearch.strongest_partners(one, "item", "d", "v").count() == 0


# ---- density clusters ---------------------------------------------------------------------------


def labels_by_force(z, eps, least):
    near = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label = {i: i for i in np.flatnonzero(core)}
    changed = True
    while changed:
        changed = False
        for i in label:
            low = min(label[j] for j in np.flatnonzero(near[i] & core))
            changed |= low != label[i]
            label[i] = low
    return [label[i] if core[i] else min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(z))], core


@pytest.mark.parametrize("dims,block", [(2, 10), (4, 1000)])
def test_density_clusters_with_copies_and_default_radius(spark, dims, block):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0, 0.3, (60, dims)), rng.normal(3, 0.6, (50, dims)), rng.uniform(-6, 6, (25, dims)), np.full((60, dims), 1.5)])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), **{f"c{k}": x[:, k] for k in range(dims)}}))
    columns = [f"c{k}" for k in range(dims)]
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    radius = np.quantile(np.sort(d, axis=1)[:, 3], 0.75)
    core, got_radius = clustering.density_core(df, "id", columns, block=block)
    assert got_radius == pytest.approx(radius)
    assert [r.n for r in core.orderBy("id").collect()] == (d <= got_radius).sum(1).tolist()
    want, is_core = labels_by_force(z, got_radius, dims + 1)
    rows = clustering.density_clusters(df, "id", columns, block=block).orderBy("id").collect()
    assert [r.cluster for r in rows] == want and [r.is_core for r in rows] == is_core.tolist()


def test_parts_of_one_full_cell_do_not_meet(spark):
    points = spark.range(400).select("id", F.array(F.col("id") * 1e-9, F.lit(0.0)).alias("x"))
    vectors = density.vectors_of(points)
    packed = density.packs(vectors, 1.0, 2, 20)
    assert packed.count() >= 10
    assert density.over_pairs(packed, 2, lambda a, b, same: iter([pd.DataFrame({"n": [1]})]), "n long", 5).count() == 0


# ---- trees ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0, 5, 0) * x[:, 2] + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y}))
    inputs = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    kinds = ("random_forest", "gradient_boost", "elastic_net")
    return df, {k: Pipeline(stages=[inputs, forecast.make_regressor(k, "label", trees=8, depth=4)]).fit(df) for k in kinds}


def test_spread_of_trees_equals_single_trees(fitted):
    df, models = fitted
    forest = models["random_forest"].stages[-1]
    rows = models["random_forest"].stages[0].transform(df)
    got = trees.with_tree_spread(forest, rows, "m", "sd").select("prediction", "m", "sd").collect()
    single = np.array([[r.prediction for r in t.transform(rows).collect()] for t in forest.trees])
    assert np.allclose([r.m for r in got], single.mean(0)) and np.allclose([r.sd for r in got], single.std(0))
    assert np.allclose([r.m for r in got], [r.prediction for r in got])


@pytest.mark.parametrize("factor", ["a", "b"])
def test_partial_dependence_equals_predicting_all_rows(fitted, factor):
    df, models = fitted
    values = [-2.0, -0.3, 0.0, 0.4, 1.9]
    got = trees.partial_dependence({k: m.stages[-1] for k, m in models.items()}, df, ["a", "b", "c"], factor, values)
    for k, m in models.items():
        want = [m.transform(df.withColumn(factor, F.lit(v))).agg(F.avg("prediction")).first()[0] for v in values]
        assert np.allclose(got[k], want), k


def test_scenarios_in_one_pass_equal_single_ones(spark):
    rng = np.random.default_rng(8)
    data = {c: rng.normal(10, 3, 300) for c in forecast.WEATHER_INPUTS}
    rows = spark.createDataFrame(pd.DataFrame({**data, "label": data["avg_temperature"] * 2 + data["lag_1"], "sale_date": [day(i) for i in range(300)]}))
    inputs = VectorAssembler(inputCols=forecast.WEATHER_INPUTS, outputCol="features")
    models = {k: Pipeline(stages=[inputs, forecast.make_regressor(k, "label", trees=5, depth=3)]).fit(rows) for k in ("random_forest", "elastic_net")}
    hot = {"avg_temperature": F.col("avg_temperature") + 8}
    got = {r.scenario: r for r in forecast.scenario_predictions(models, rows, {"hot": hot}).collect()}
    changed = rows.withColumns(hot).withColumn("temp_humidity", F.col("avg_temperature") * F.col("avg_humidity") / 100)
    mean = lambda df: forecast.weather_ensemble(models, df).agg(F.avg("prediction")).first()[0]
    assert got["baseline"].mean_prediction == pytest.approx(mean(rows)) and got["baseline"].change_pct == 0
    assert got["hot"].mean_prediction == pytest.approx(mean(changed))


@pytest.mark.parametrize("rows,parts", [(0, 1), (15_000, 1), (60_000, 2), (2_000_000, 12), (19_800_000, 48)])
def test_model_rows_lie_in_few_parts(rows, parts):
    assert forecast.model_parts(rows, 12) == parts


def test_rows_of_forests_are_held_in_few_parts(spark):
    cores = spark.sparkContext.defaultParallelism
    with forecast.cached(spark.range(1000).repartition(20 * cores), forecast.model_parts) as held:
        assert held.rdd.getNumPartitions() == 1 and sorted(r.id for r in held.collect()) == list(range(1000))


def test_model_rows_are_written_once_in_few_parts(spark):
    rows = spark.range(500).select(F.col("id").cast("double").alias("label")).repartition(40)
    held = forecast.dealt(rows)
    assert held.rdd.getNumPartitions() <= 2 and all("/rows-" in f for f in held.inputFiles())
    assert sorted(r.label for r in held.collect()) == list(range(500))


def test_rows_that_keep_their_nodes_give_the_same_forest(fitted):
    df, _ = fitted
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    forest = forecast.make_regressor("random_forest", "label", trees=8, depth=6)
    assert forest.getCacheNodeIds()
    text = lambda m: m.toDebugString.split("\n", 1)[1]
    assert text(forest.fit(rows)) == text(forest.copy().setCacheNodeIds(False).fit(rows))


# ---- fold statistics -------------------------------------------------------------------------------


def test_coefficients_equal_fits_of_each_fold(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.1, 1] + [5, 0, 1, 0]
    x[:, 3] = 2.0  # no spread
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(0, 1, 300)
    df = spark.createDataFrame(pd.DataFrame({**{f"x{i}": x[:, i] for i in range(4)}, "label": y, "f": np.arange(300) % 3}))
    inputs = [f"x{i}" for i in range(4)]
    moments = linearfolds.fold_moments(df, F.col("f"), inputs, "label")
    assert [m.rows for m in moments.values()] == [100, 100, 100]
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(df)
    for reg, elastic in ((0.0, 0.0), (0.01, 0.0), (0.5, 0.0), (0.1, 0.5), (0.3, 1.0)):
        scores = []
        for f in range(3):
            train = sum((moments[g] for g in range(3) if g not in (f, (f + 1) % 3)), moments[(f + 1) % 3])
            intercept, coefficients = train.fit(reg, elastic)
            model = LinearRegression(labelCol="label", regParam=reg, elasticNetParam=elastic, tol=1e-12, maxIter=1000).fit(rows.filter(F.col("f") != f))
            assert coefficients == pytest.approx(model.coefficients.toArray(), abs=1e-5) and intercept == pytest.approx(model.intercept, abs=1e-4)
            p = model.transform(rows.filter(F.col("f") == f))
            e = F.col("label") - F.col("prediction")
            want = p.agg(F.avg(e * e), 1 - F.avg(e * e) / F.var_pop("label")).first()
            got = moments[f].error(intercept, coefficients)
            assert got == pytest.approx(tuple(want), rel=1e-4)
            scores.append(got[0] ** 0.5)
        assert linearfolds.cross_validated(moments, [(reg, elastic)])[0][0] == pytest.approx(np.mean(scores))


# ---- crowded transfers ------------------------------------------------------------------------------


def test_one_item_in_one_city_is_many_parts(spark):
    n = 3000
    at = spark.range(n).select(
        F.col("id").alias("store_id"), F.lit(1).alias("product_id"), F.lit(5).alias("city_id"), (F.col("id") % 7 / 10 + 30.0).alias("latitude"), (F.col("id") % 5 / 10 + 100.0).alias("longitude"),
        F.when(F.col("id") % 20 == 0, 500.0).otherwise(1.0).alias("current_stock"), F.lit(20.0).alias("safety_stock"), F.lit(3.0).alias("avg_daily_sales"),
        F.when(F.col("id") % 20 == 0, 100.0).otherwise(0.5).alias("days_of_inventory"), F.when(F.col("id") % 20 == 0, "overstock").otherwise("stockout_risk").alias("stock_status"),
    )
    key = ["source_store_id", "target_store_id", "product_id"]
    whole = inventory.transfer_opportunities(at, cell_pairs=1 << 40)
    parts = inventory.transfer_opportunities(at, cell_pairs=5000)
    assert parts.count() == whole.count() > 100_000
    assert parts.exceptAll(whole.select(*parts.columns)).count() == 0 and parts.select(*key).distinct().count() == parts.count()


def test_overstock_goes_to_occupied_touching_cells_only(spark):
    rng = np.random.default_rng(5)
    cells = lambda n: pd.DataFrame({"store_id": np.arange(n), "product_id": rng.integers(0, 3, n), **{c: rng.integers(-12, 12, n) for c in ("_x", "_y", "_z")}})
    src, dst = cells(150), cells(400)
    got = inventory._reaching(spark.createDataFrame(src), spark.createDataFrame(dst), "product_id")
    taken = {tuple(r) for r in dst[["product_id", "_x", "_y", "_z"]].to_numpy().tolist()}
    want = [
        (s, p, x + i, y + j, z + k)
        for s, p, x, y, z in src.itertuples(index=False, name=None)
        for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)
        if (p, x + i, y + j, z + k) in taken
    ]
    assert sorted(tuple(r) for r in got.select("store_id", "product_id", "_x", "_y", "_z").collect()) == sorted(want)
    assert 0 < len(want) < 27 * len(src) / 4


def test_rounds_of_components_keep_the_size_of_their_rows(spark):
    nodes = spark.range(100)
    links = nodes.where("id > 0").select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    found = clustering.connected_labels(nodes, links)
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(100)}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**40


# ---- cross effects ----------------------------------------------------------------------------------


@pytest.mark.parametrize("keys", [[], ["store_id"]])
def test_cross_effects_from_promoted_days_and_sums_equal_brute_force(spark, keys):
    rng = np.random.default_rng(4)
    rows = [(s, i, dt.date(2024, 1, 1) + dt.timedelta(days=int(d)), None if rng.random() < 0.1 else int(rng.integers(1, 90)), bool(rng.random() < 0.4))
            for s in range(2 if keys else 1) for i in "abcd" for d in rng.choice(40, 25, replace=False)]
    daily = spark.createDataFrame(rows, "store_id long, item string, sale_date date, sale_amount long, activity_flag boolean")
    pairs = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "d"), ("d", "x")]
    out = promotions.cross_effects(daily, spark.createDataFrame(pairs, "item_a string, item_b string"), "item", keys)
    want = set()
    for s in {r[0] for r in rows}:
        for a, b in set(pairs):
            on = {r[2] for r in rows if r[0] == s and r[1] == a and r[4]}
            sold = [(r[2] in on, r[3]) for r in rows if r[0] == s and r[1] == b and r[3] is not None]
            during, normal = ([v for o, v in sold if o == w] for w in (True, False))
            if during and normal:
                want.add((s if keys else 0, a, b, round(sum(during) / len(during), 6), round(sum(normal) / len(normal), 6)))
    got = {(r.store_id if keys else 0, r.item_a, r.item_b, round(r.during, 6), round(r.normal, 6)) for r in out.collect()}
    assert got == want and len(want) >= 3
    assert out.inputFiles() and all("/rows-" in f for f in out.inputFiles())  # the daily rows are made once


@pytest.mark.parametrize("rows, trees, together", [(10, 100, 100), (2_000_000, 100, 100), (4_000_000, 100, 50), (10**9, 100, 10), (10**9, 5, 5), (0, 7, 7)])
def test_trees_of_many_rows_do_not_grow_all_at_once(rows, trees, together):
    assert forecast.trees_at_once(rows, trees) == together


def test_a_forest_grown_in_batches_is_whole(spark, monkeypatch):
    df = spark.range(2000).select((F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 89).cast("double").alias("b"))
    df = df.withColumn("label", 3 * F.col("a") + F.sin("b")).repartition(3).persist()
    pipe = forecast.assembled(["a", "b"], forecast.make_regressor("random_forest", "label", trees=24, depth=5))
    error = lambda m: m.transform(df).agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0]
    once = pipe.fit(df)
    monkeypatch.setattr(forecast, "ROW_TREES", 1)
    batched = pipe.fit(df)
    forest = batched.stages[-1]
    assert forest.getNumTrees == len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) == 24  # no draw twice
    assert len(forecast.trees.trees_of(forest)) == 24 and abs(sum(forest.featureImportances.toArray()) - 1) < 1e-9
    assert error(batched) < 1.3 * error(once) + 1
    df.unpersist()
