"""Streaming jobs over several files: late rows, state across batches, replay."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aislecast.schemas import RAW
from aislecast.streaming import monitors as mon

T0 = dt.datetime(2024, 1, 1)


def ev(i, minutes, user=1, kind="view", value=1.0):
    return (i, T0 + dt.timedelta(minutes=minutes), user, kind, value, "{}")


def write_files(spark, tmp_path, batches):
    """One file per batch, with rising modification times so that they are read in order."""
    import os

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, RAW["events"]).toPandas().to_parquet(tmp_path / f"events-{n}.parquet", coerce_timestamps="us")
        os.utime(tmp_path / f"events-{n}.parquet", (1_700_000_000 + n * 10, 1_700_000_000 + n * 10))
    return str(tmp_path)


def test_late_rows_are_dropped(spark, tmp_path):
    # the watermark of 190 minutes is known after the second batch and applies to late rows two batches on
    path = write_files(spark, tmp_path, [[ev(1, 5), ev(2, 10)], [ev(3, 200)], [ev(4, 250)], [ev(5, 15), ev(6, 400)]])
    out = mon.run_to_end(mon.tumbling_counts(mon.event_stream(spark, path, 1)))
    got = {r.window_start: r.n for r in out.collect()}
    assert got[T0] == 2


def test_stream_equals_batch_without_late_rows(spark, tmp_path):
    rows = [ev(i, i * 7, user=i % 3) for i in range(60)]
    path = write_files(spark, tmp_path, [rows[:20], rows[20:40], rows[40:]])
    out = {(r.window_start, r.n) for r in mon.run_to_end(mon.tumbling_counts(mon.event_stream(spark, path, 1))).collect()}
    batch = spark.read.schema(RAW["events"]).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    last = rows[-1][1] - dt.timedelta(minutes=10)
    want = {(r.window_start, r.n) for r in mon.tumbling_counts(batch).collect() if r.window_start + dt.timedelta(hours=1) <= last}
    assert out == want


OUTAGES = [ev(1, 0, 1, "error"), ev(2, 1, 2, "purchase"), ev(3, 5, 1, "error"), ev(4, 6, 2, "error"), ev(5, 30, 1, "purchase"), ev(6, 31, 1, "purchase"),
           ev(7, 40, 1, "error"), ev(8, 50, 3, "error"), ev(9, 55, 1, "purchase"), ev(10, 70, 3, "view"), ev(11, 90, 3, "purchase")]


@pytest.mark.parametrize("cuts", [[], [4, 8], list(range(1, 11))])
def test_outage_state_survives_batches(spark, tmp_path, cuts):
    edges = [0, *cuts, len(OUTAGES)]
    path = write_files(spark, tmp_path, [OUTAGES[a:b] for a, b in zip(edges, edges[1:])])
    out = mon.run_complete(spark, path, mon.outages, files_per_trigger=1).collect()
    minutes = lambda m: T0 + dt.timedelta(minutes=m)
    assert sorted((r.user_id, r.start_time, r.duration_seconds) for r in out) == [(1, T0, 1800.0), (1, minutes(40), 900.0), (3, minutes(50), 2400.0)]


@pytest.mark.parametrize("files", [1, 3, 10])
@pytest.mark.parametrize("job", [mon.tumbling_counts, mon.sessions, mon.outages])
def test_results_do_not_depend_on_batches(spark, tmp_path, job, files):
    import random

    kinds = ["error", "purchase", "view"]
    rows = [ev(i, i * 7 + (i // 20) * 300, user=i % 3, kind=kinds[i * i % 3 if i % 5 else 0]) for i in range(60)]
    shuffled = rows[:]
    random.Random(files).shuffle(shuffled)
    path = write_files(spark, tmp_path, [shuffled[i::files] for i in range(files)])
    out = mon.run_complete(spark, path, job, files_per_trigger=1, late="30 days")
    got = sorted(tuple(map(str, r)) for r in out.collect())
    if job is mon.outages:
        want = []
        for u in range(3):
            opened = None
            for _, ts, _, kind, _, _ in (r for r in rows if r[2] == u):
                if kind == "error" and opened is None:
                    opened = ts
                elif kind == "purchase" and opened is not None:
                    want.append(tuple(map(str, (u, opened, ts, (ts - opened).total_seconds()))))
                    opened = None
        assert got == sorted(want) and got
    else:
        batch = spark.read.schema(RAW["events"]).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
        assert got == sorted(tuple(map(str, r)) for r in job(batch).collect())


JOBS = [(mon.tumbling_counts, {}), (mon.sessions, {}), (mon.outages, {}), (mon.spikes, {"threshold": 0.0, "size": "2 hours", "slide": "1 hour"})]


@pytest.mark.parametrize("job,options", JOBS)
def test_a_stream_goes_on_with_later_files(spark, tmp_path, job, options):
    kinds = ["error", "purchase", "view"]
    rows = [ev(i, i * 9, user=i % 2, kind=kinds[i * i % 3 if i % 4 else 0]) for i in range(80)]
    (tmp_path / "whole").mkdir()
    (tmp_path / "parts").mkdir()
    once = mon.run_complete(spark, write_files(spark, tmp_path / "whole", [rows]), job, **options).collect()
    folder, seen = str(tmp_path / "run"), []
    for upto in (30, 31, 80):
        seen.append(rows[len(sum(seen, [])) : upto])
        got = mon.run_complete(spark, write_files(spark, tmp_path / "parts", seen), job, folder=folder, **options).collect()
    text = lambda r: tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(text, got)) == sorted(map(text, once)) and once


def test_every_window_from_the_second_on_is_judged(spark, tmp_path):
    counts = [3, 5, 4, 9, 1]
    rows = [ev(100 * h + i, 60 * h + i, kind="a") for h, n in enumerate(counts) for i in range(n)]
    out = mon.run_complete(spark, write_files(spark, tmp_path, [rows[:9], rows[9:]]), mon.spikes, 1, size="1 hour", slide="1 hour", threshold=0.0)
    got = {r.window_start: r.z_score for r in out.collect()}
    for h in range(1, len(counts)):
        mean = sum(counts[:h]) / h
        spread = max((sum((c - mean) ** 2 for c in counts[:h]) / max(h - 1, 1)) ** 0.5, mean**0.5)
        assert got[T0 + dt.timedelta(hours=h)] == pytest.approx((counts[h] - mean) / spread)
    assert len(got) == len(counts) - 1


def test_outage_state_is_one_entry_per_waiting_event(spark, tmp_path):
    rows = [ev(i, i, user=1, kind="error" if i % 2 else "purchase") for i in range(40)]
    folder = str(tmp_path / "run")
    (tmp_path / "in").mkdir()
    path = write_files(spark, tmp_path / "in", [rows])
    mon.advance(mon.outages(mon.event_stream(spark, path), late="1 day"), folder)
    waiting = mon.state_rows(spark, folder, 0, "waiting")
    assert waiting.count() == 40 and waiting.agg(F.max(F.size("user_map_value.events"))).first()[0] == 1


def test_a_batch_brings_a_key_one_timer(spark, tmp_path):
    rows = [ev(i, i, user=i % 3, kind="error" if i % 2 else "purchase") for i in range(60)]
    folder = str(tmp_path / "run")
    (tmp_path / "in").mkdir()
    mon.advance(mon.outages(mon.event_stream(spark, write_files(spark, tmp_path / "in", [rows])), late="1 day"), folder)
    with mon.rocksdb(spark):
        timers = spark.read.format("statestore").option("readRegisteredTimers", True).load(f"{folder}/state").collect()
    assert len(timers) == 3


@pytest.mark.parametrize("many", [0, 3, 12])
def test_crowded_keys_have_the_same_outages(spark, tmp_path, many):
    kinds = ["error", "purchase", "view"]
    rows = [ev(i, i * 9 - i % 7 * 5, user=i % 2, kind=kinds[i * i % 3 if i % 4 else 0]) for i in range(60)]
    path = write_files(spark, tmp_path, [rows[:25], rows[25:26], rows[26:]])
    text = lambda df: sorted(map(str, df.collect()))
    want = text(mon.run_complete(spark, path, mon.outages, 1, late="2 hours"))
    assert text(mon.run_complete(spark, path, mon.outages, 1, late="2 hours", many=many)) == want and want


def test_duplicates_across_batches(spark, tmp_path):
    path = write_files(spark, tmp_path, [[ev(1, 0), ev(2, 1)], [ev(3, 2), ev(4, 3, kind="click")]])
    out = mon.run_to_end(mon.deduplicated(mon.event_stream(spark, path, 1)))
    assert sorted(r.event_type for r in out.collect()) == ["click", "view"]


@pytest.mark.parametrize("replay", [1, 2])
def test_batch_sink_is_idempotent(spark, tmp_path, replay):
    path = write_files(spark, tmp_path, [[ev(1, 0), ev(2, 1)], [ev(3, 2)]])

    def handle(batch, base):
        for _ in range(replay - 1):  # what a replayed batch writes first
            batch.write.mode("overwrite").parquet(f"{base}/out/batch_id=0")
        return batch

    out = mon.run_batches(mon.event_stream(spark, path, 2), handle)
    assert spark.read.parquet(out).count() == 3
