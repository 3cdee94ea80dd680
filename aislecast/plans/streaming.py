"""Streaming queries: each runs a job to the end of the event files and reads its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import monitors as mon
from .registry import q, query


def _events(t):
    return mon.event_stream(t.spark, t.path)


@query(
    "stream_tumbling_counts",
    "STR-1",
    f"""
, w AS (SELECT date_trunc('hour', ts) s, event_type, count(*) n, sum(CAST(value AS DECIMAL(12,2))) v FROM events GROUP BY 1,2)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n, {q('v')} AS total FROM w""",
)
def stream_tumbling_counts(t):
    return mon.run_complete(t.spark, t.path, mon.tumbling_counts)


@query(
    "stream_spikes",
    "STR-2",
    f"""
, e AS (SELECT event_type, unnest([0,1,2,3]) k, time_bucket(INTERVAL 6 HOUR, ts) b FROM events),
w AS (SELECT b - k*INTERVAL 6 HOUR s, event_type, count(*) n FROM e GROUP BY 1,2),
bl AS (SELECT *, avg(n) OVER p m, greatest(coalesce(stddev_samp(n) OVER p, 0), sqrt(avg(n) OVER p)) sd FROM w WINDOW p AS (PARTITION BY event_type ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (n-m)/sd z FROM bl WHERE m IS NOT NULL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n, {q('z')} AS z_score FROM z WHERE abs(z)>=1.5""",
)
def stream_spikes(t):
    """Every window from a type's second on, judged by the type's windows before it."""
    return mon.run_complete(t.spark, t.path, mon.spikes, threshold=1.5)


@query(
    "stream_sessions",
    "STR-3",
    f"""
, g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END nw FROM events),
i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) sid FROM g),
s AS (SELECT user_id, sid, min(ts) st, max(ts) en, count(*) n, sum(CAST(value AS DECIMAL(12,2))) v FROM i GROUP BY 1,2)
SELECT strftime(st, '%Y-%m-%d %H:%M:%S') AS session_start, user_id, n AS events, {q('v')} AS total FROM s""",
)
def stream_sessions(t):
    return mon.run_complete(t.spark, t.path, mon.sessions)


@query("stream_deduplicated_alerts", "STR-4", "SELECT DISTINCT user_id, event_type, ts::DATE::VARCHAR AS day FROM events")
def stream_deduplicated_alerts(t):
    return mon.run_to_end(mon.deduplicated(_events(t)))


@query(
    "stream_outages",
    "STR-5",
    f"""
, e AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) pv FROM events WHERE event_type IN ('error','purchase')),
o AS (SELECT user_id, ts FROM e WHERE event_type='error' AND (pv IS NULL OR pv='purchase')),
c AS (SELECT o.user_id, o.ts st, (SELECT min(x.ts) FROM events x WHERE x.user_id=o.user_id AND x.event_type='purchase' AND x.ts>o.ts) en FROM o)
SELECT user_id, strftime(st, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(en, '%Y-%m-%d %H:%M:%S') AS end_time, {q('date_diff(\'microsecond\', st, en)/1e6', 3)} AS duration_seconds FROM c WHERE en IS NOT NULL""",
    digits=3,
)
def stream_outages(t):
    return mon.run_complete(t.spark, t.path, mon.outages)


@query(
    "stream_enriched",
    "STR-6 STR-7",
    f"""
SELECT n_nationkey AS city_id, c_mktsegment AS segment, event_type, count(*) AS n, {q('sum(CAST(value AS DECIMAL(12,2)))')} AS total
FROM events JOIN customer ON c_custkey=user_id JOIN nation ON n_nationkey=c_nationkey GROUP BY 1,2,3""",
)
def stream_enriched(t):
    c, n = t.raw("customer"), t.raw("nation")
    dim = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("user_id"), F.col("n_nationkey").alias("city_id"), F.col("c_mktsegment").alias("segment")
    )
    out = mon.run_batches(mon.enriched(_events(t), dim), lambda b, _: b)
    schema = "event_id bigint, user_id bigint, event_type string, city_id int, segment string, value double, batch_id bigint"
    rows = t.spark.read.schema(schema).parquet(out)
    return rows.groupBy("city_id", "segment", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).alias("total")
    )
