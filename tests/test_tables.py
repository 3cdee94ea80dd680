"""Versions that share files, views kept up by changes, pages found by fences."""

import pytest
from pyspark.sql import functions as F

from aislecast.sources import versioned
from aislecast.sources.paging import PageIndex
from aislecast.sources.views import View


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, name string, v long")


def rows_of(df):
    return sorted((r.k, r.name, r.v) for r in df.collect())


def test_untouched_files_are_shared_by_both_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [(i, f"n{i}", i) for i in range(200)]
    assert versioned.create(table(spark, old), path, ["k"], 16) == 1
    assert versioned.upsert(table(spark, [(3, "new", 33), (500, "more", 5)]), path) == 2
    first, second = versioned.manifest(spark, path, 1), versioned.manifest(spark, path)
    changed = {b for b in second.folders if second.folders[b] != first.folders.get(b)}
    assert 1 <= len(changed) <= 2 and second.version == 2
    assert rows_of(versioned.read(spark, path, 1)) == sorted(old)
    want = sorted([r for r in old if r[0] != 3] + [(3, "new", 33), (500, "more", 5)])
    assert rows_of(versioned.read(spark, path)) == want
    files = set(versioned.read(spark, path, 1).inputFiles()) & set(versioned.read(spark, path).inputFiles())
    assert len(files) >= 14


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.create(table(spark, [(1, "a", 1), (2, "b", 2)]), path, ["k"], 4)
    broken = table(spark, [(1, "c", 3)]).withColumn("v", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        versioned.upsert(broken, path)
    assert versioned.versions(spark, path) == [1]
    assert rows_of(versioned.read(spark, path)) == [(1, "a", 1), (2, "b", 2)]


def test_a_taken_version_is_a_conflict(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.create(table(spark, [(1, "a", 1)]), path, ["k"], 4)
    base = versioned.manifest(spark, path)
    versioned.upsert(table(spark, [(2, "b", 2)]), path)
    late = table(spark, [(9, "z", 9)]).withColumn("bucket", versioned.hash_bucket(["k"], 4))
    with pytest.raises(versioned.VersionConflict):
        versioned.replace(late, path, base, versioned.touched_buckets(late))
    assert rows_of(versioned.read(spark, path)) == [(1, "a", 1), (2, "b", 2)]


def test_empty_changes_deletes_and_single_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.create(table(spark, [(i, "a", i) for i in range(10)]), path, ["k"], 4)
    assert versioned.upsert(table(spark, []), path) == 1
    assert versioned.delete(spark.createDataFrame([(4,), (77,)], "k long"), path) == 2
    assert [r[0] for r in rows_of(versioned.read(spark, path))] == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    some = next(iter(versioned.manifest(spark, path).folders))
    own = versioned.read(spark, path, buckets=[some])
    assert 0 < own.count() < 9 and own.filter(versioned.hash_bucket(["k"], 4) != some).count() == 0
    assert versioned.read(spark, path, buckets=["none"]).count() == 0
    versioned.create(table(spark, []), str(tmp_path / "e"), ["k"])
    assert versioned.read(spark, str(tmp_path / "e")).count() == 0


SALES = "day string, shop int, product int, amount decimal(12,2), units long"


def test_a_view_after_changes_equals_the_whole_aggregate(spark, tmp_path):
    import random
    from decimal import Decimal

    rng = random.Random(1)
    make = lambda: (f"2024-01-{rng.randint(1, 9):02d}", rng.randint(1, 3), rng.randint(1, 5), Decimal(rng.randint(1, 9999)) / 100, rng.randint(1, 9))
    live = [make() for _ in range(300)]
    view = View(str(tmp_path / "v"), ["day", "shop"], "day", {"amount": "amount", "units": "units"}, "product")
    view.create(spark.createDataFrame(live, SALES))
    for step in range(3):
        days = {f"2024-01-{2 * step + 1:02d}", f"2024-01-{2 * step + 2:02d}"}
        gone = [r for r in live if r[0] in days][: 40 if step else 1000]  # the first step empties its days
        new = [(d, s, p, a, u) for d, s, p, a, u in (make() for _ in range(60)) if d in days]
        for r in gone:
            live.remove(r)
        live += new
        before = versioned.manifest(spark, view.path)
        changes = spark.createDataFrame([(*r, 1) for r in new] + [(*r, -1) for r in gone], SALES + ", sign int")
        view.apply(changes)
        after = versioned.manifest(spark, view.path)
        assert {b for b in set(before.folders) | set(after.folders) if before.folders.get(b) != after.folders.get(b)} <= days
    whole = spark.createDataFrame(live, SALES).groupBy("day", "shop").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount"), F.sum("units").alias("units"), F.count_distinct("product").alias("distinct_product")
    )
    text = lambda df: sorted((r.day, r.shop, r["rows"], float(r.amount), r.units, r.distinct_product) for r in df.collect())
    assert text(view.read(spark)) == text(whole)
    with pytest.raises(ValueError, match="withdrawn"):
        view.apply(spark.createDataFrame([("2024-01-09", 99, 1, Decimal(1), 1, -1)], SALES + ", sign int"))


def test_a_deep_page_reads_one_range(spark, tmp_path):
    rows = spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("k"), (F.col("id") % 10).alias("x"))
    index = PageIndex(str(tmp_path / "p"), ["k"])
    index.build(rows, rows=500)
    assert index.count(spark) == 50_000
    page = index.page(spark, 3000, 10)
    assert [r.k for r in page.collect()] == list(range(30_000, 30_010))
    assert len({f.split("key_range=")[1].split("/")[0] for f in page.inputFiles()}) == 1
    for number, size in ((0, 7), (71, 700), (49_999, 1), (5, 10_000)):
        assert [r.k for r in index.page(spark, number, size).collect()] == list(range(50_000))[number * size : (number + 1) * size]
    assert index.page(spark, 10_000, 10).count() == 0
    assert [r.k for r in index.after(spark, (41_234,), 5).collect()] == list(range(41_235, 41_240))
    assert [r.k for r in index.after(spark, (49_997,), 5).collect()] == [49_998, 49_999]
    assert index.after(spark, (60_000,), 5).count() == 0
