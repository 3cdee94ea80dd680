"""Structured Streaming jobs over the event files.

Every job takes a streaming frame and returns a streaming frame. ``advance`` processes what is available from where a folder's
checkpoint stands and leaves the rows in that folder, so a stop, a restart or more files change nothing. ``run_complete`` also tells
what is still open when the input has ended: it reads the windows, sessions, waiting events and moments that the state store holds
(``STILL_OPEN``) and adds their rows to the written ones. The watermark stays where the events have moved it, so the
same folder can go on with later files. Results do not depend on how the files fall into batches as long as ``late`` covers the
disorder of the events.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import RAW
from ..session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Events as a stream of the files in a folder, at most ``files_per_trigger`` per batch."""
    events = (
        spark.readStream.schema(RAW["events"])
        .option("pathGlobFilter", "events*.parquet")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def run_folder(spark: SparkSession) -> str:
    """A new folder for one run below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Processes all available input and reads the appended rows back."""
    spark = stream.sparkSession
    base = run_folder(spark)
    q = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, str], DataFrame | None], mode: str = "append") -> str:
    """Runs ``handle`` on every batch and writes what it returns to a folder of that batch id.

    The folder is overwritten, so a batch that is replayed after a failure leaves its rows once.
    """
    base = run_folder(stream.sparkSession)

    def sink(batch: DataFrame, batch_id: int) -> None:
        out = handle(batch, base)
        if out is not None:
            out.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    q = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return f"{base}/out"


@contextmanager
def rocksdb(spark: SparkSession, wanted: bool = True):
    """Streams started inside keep their state in RocksDB, which state variables and timers need."""
    before = spark.conf.get(PROVIDER)
    if wanted:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def advance(stream: DataFrame, folder: str, variables: bool = True) -> DataFrame:
    """Processes the input that is available from where ``folder`` stands, and all rows written there so far.

    Rows of a batch go to a folder of its id, which is overwritten, so a batch that is replayed after a failure leaves its rows once.
    ``variables``: the stream has state variables or timers.
    """
    spark = stream.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    with rocksdb(spark, variables):
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/out/batch_id=-1")
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def state_rows(spark: SparkSession, folder: str, operator: int = 0, variable: str | None = None) -> DataFrame:
    """The state that a stream has left in ``folder``: of a stateful operator, or of one of its variables."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    with rocksdb(spark, variable is not None or operator > 0):
        return (reader.option("stateVarName", variable) if variable else reader).load(f"{folder}/state")


def run_complete(
    spark: SparkSession, path: str, job: Callable[..., DataFrame], files_per_trigger: int = 100, folder: str | None = None, **options
) -> DataFrame:
    """All rows of a job over the events so far, closed or still open; with the same ``folder`` a later call goes on."""
    folder = folder or run_folder(spark)
    closed = advance(job(event_stream(spark, path, files_per_trigger), **options), folder, job in (spikes, outages))
    return closed.unionByName(STILL_OPEN[job](spark, folder, **options))


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and value per window and type; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
    )


def sliding_counts(events: DataFrame, size: str = "1 day", slide: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size, slide), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n")
    )


class Baseline(StatefulProcessor):
    """Judges each window's count by the windows of its type before it, then adds it to them; the state is three numbers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", "k long, s long, ss long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        k, s, ss = self.moments.get() if self.moments.exists() else (0, 0, 0)
        windows = pd.concat([r for r in rows]).sort_values("window_start")
        out = []
        for start, n in zip(windows["window_start"], windows["n"].astype(int)):
            if k:
                out.append((start, key[0], n, (n - s / k) / max((max(ss - s * s / k, 0.0) / max(k - 1, 1)) ** 0.5, (s / k) ** 0.5)))
            k, s, ss = k + 1, s + int(n), ss + int(n) * int(n)
        self.moments.update((k, s, ss))
        yield pd.DataFrame(out, columns=["window_start", "event_type", "n", "z_score"]).astype({"event_type": object, "n": "int64", "z_score": "float64"})

    def close(self) -> None:
        pass


SPIKE = "window_start timestamp, event_type string, n long, z_score double"


def spikes(events: DataFrame, size: str = "1 day", slide: str = "6 hours", late: str = "10 minutes", threshold: float = 2.0) -> DataFrame:
    """Sliding windows whose count is ``threshold`` deviations from the mean of the earlier windows of the type.

    The deviation is that of the earlier counts, at least the square root of their mean (a lone earlier window has no other), so
    each window from the second on is judged.
    """
    judged = sliding_counts(events, size, slide, late).groupBy("event_type").transformWithStateInPandas(Baseline(), SPIKE, "append", "none")
    return judged.filter(F.abs("z_score") >= threshold)


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(12,2)")).alias("total"))
        .select(F.col("session_window.start").alias("session_start"), "user_id", "events", "total")
    )


def deduplicated(events: DataFrame, expiry: str = "7 days") -> DataFrame:
    """First alert of each user, type and day; keys are forgotten after ``expiry``."""
    keyed = events.withColumn("day", F.to_date("ts")).withWatermark("ts", expiry)
    return keyed.dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


def enriched(events: DataFrame, dim: DataFrame) -> DataFrame:
    """Stream-static join with a dimension on the user id."""
    return events.join(dim, "user_id").select("event_id", "user_id", "event_type", "city_id", "segment", "value")


OUTAGE = "user_id bigint, start_time timestamp, end_time timestamp, duration_seconds double"
WAITING = "array<struct<ts:timestamp,event_id:bigint,down:boolean>>"


class Outages(StatefulProcessor):
    """Waiting events of a key by their millisecond, how many there are, and when its open interval began.

    An event is one entry. What a batch brings to a key is one timer, at its last event: when the watermark has passed it, the entries up
    to it are read in one pass, applied in order and removed. A key with more than ``many`` entries is crowded until they are
    gone: each entry has its own timer and is read alone, so no more than ``many`` are in memory.
    """

    def __init__(self, keep_ms: int, many: int = 10_000):
        self.keep, self.many = keep_ms, many

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", f"events {WAITING}")
        self.opened = handle.getValueState("opened", "ts timestamp")
        self.held = handle.getValueState("held", "entries long, crowded boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size, crowded = self.held.get() if self.held.exists() else (0, False)
        last = None
        for batch in rows:
            new: dict[int, list] = {}
            for ts, event_id, down in zip(batch["ts"], batch["event_id"], batch["down"]):
                new.setdefault(int(ts.timestamp() * 1000), []).append((ts.to_pydatetime(), int(event_id), bool(down)))
            known = size > 0
            for at, events in new.items():
                there = self.waiting.getValue((at,))[0] if known and self.waiting.containsKey((at,)) else []
                self.waiting.updateValue((at,), ([*[tuple(h) for h in there], *events],))
                size += not len(there)
                if crowded:
                    self.handle.registerTimer(at)
            last = max([*new, *([] if last is None else [last])], default=None)
            if size > self.many and not crowded:
                crowded = True
                for at in self.waiting.keys():
                    self.handle.registerTimer(at[0])
        if not crowded and last is not None:
            self.handle.registerTimer(last)
        self.held.update((size, crowded))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        before = opened = pd.Timestamp(self.opened.get()[0]) if self.opened.exists() else None
        size, crowded = self.held.get() if self.held.exists() else (0, False)
        if crowded:
            ready = {upto: self.waiting.getValue((upto,))[0]} if self.waiting.containsKey((upto,)) else {}
        else:
            ready = {at[0]: value[0] for at, value in self.waiting.iterator() if at[0] <= upto} if size else {}
        done = []
        for at in sorted(ready):
            if opened is not None and self._until(opened) < at:
                opened = None
            for ts, _, down in sorted(tuple(h) for h in ready[at]):
                ts = pd.Timestamp(ts)
                if down and opened is None:
                    opened = ts
                elif not down and opened is not None:
                    done.append((key[0], opened, ts, (ts - opened).total_seconds()))
                    opened = None
        if ready and len(ready) == size:
            self.waiting.clear()
            self.held.clear()
        elif ready:
            for at in ready:
                self.waiting.removeKey((at,))
            self.held.update((size - len(ready), crowded))
        if opened is not None and self._until(opened) <= upto:
            opened = None
        if opened is None and before is not None:
            self.opened.clear()
        elif opened is not None and opened != before:
            self.opened.update((opened.to_pydatetime(),))
            self.handle.registerTimer(self._until(opened))
        if done:
            yield pd.DataFrame(done, columns=["user_id", "start_time", "end_time", "duration_seconds"]).astype(
                {"user_id": "int64", "start_time": "datetime64[us]", "end_time": "datetime64[us]", "duration_seconds": "float64"})

    def _until(self, opened: pd.Timestamp) -> int:
        """The millisecond at which an interval that is still open is given up."""
        return int(opened.timestamp() * 1000) + self.keep

    def close(self) -> None:
        pass


def outages(
    events: DataFrame, down: str = "error", up: str = "purchase", late: str = "10 minutes", expiry: str = "90 days", many: int = 10_000
) -> DataFrame:
    """Intervals per key: opened by the first ``down`` event, closed by the next ``up`` event.

    Events wait in the state until the watermark has passed them (and the last of their batch) and are then taken in the order of time, so an
    event that comes late, or in another batch, changes nothing. An interval still open after ``expiry`` is given up, and the state of a key
    goes with its last event and interval.
    """
    kept = events.withWatermark("ts", late).filter(F.col("event_type").isin(down, up))
    kept = kept.select("user_id", "event_id", "ts", (F.col("event_type") == down).alias("down"))
    keep = int(pd.Timedelta(expiry).total_seconds() * 1000)
    return kept.groupBy("user_id").transformWithStateInPandas(Outages(keep, many), OUTAGE, "append", "eventTime")


# ---- what is still open in the state ----------------------------------------------------------


def _open_windows(spark: SparkSession, folder: str, **_) -> DataFrame:
    rows = state_rows(spark, folder)
    return rows.select(F.col("key.window.start").alias("window_start"), "key.event_type", F.col("value.count").alias("n"), F.col("value.sum").alias("total"))


def _open_sliding(spark: SparkSession, folder: str, **_) -> DataFrame:
    return state_rows(spark, folder).select(F.col("key.window.start").alias("window_start"), "key.event_type", F.col("value.count").alias("n"))


def _open_sessions(spark: SparkSession, folder: str, **_) -> DataFrame:
    rows = state_rows(spark, folder)
    return rows.select(F.col("value.session_window.start").alias("session_start"), "value.user_id", F.col("value.count").alias("events"), F.col("value.sum").alias("total"))


def _open_spikes(spark: SparkSession, folder: str, threshold: float = 2.0, **_) -> DataFrame:
    """The open windows judged by the stored moments and the open windows before them: few windows a type."""
    moments = state_rows(spark, folder, 0, "moments").select("key.event_type", "value.*")
    windows = state_rows(spark, folder, 1).select("key.event_type", F.col("key.window.start").alias("window_start"), F.col("value.count").alias("n"))
    up = W.partitionBy("event_type").orderBy("window_start").rowsBetween(W.unboundedPreceding, -1)
    square = F.col("n") * F.col("n")
    sums = windows.join(moments, "event_type", "left").select(
        "window_start", "event_type", "n",
        *[(F.coalesce(c, F.lit(0)) + F.coalesce(F.sum(x).over(up), F.lit(0))).alias(c) for c, x in (("k", F.lit(1)), ("s", F.col("n")), ("ss", square))],
    )
    mean = F.col("s") / F.col("k")
    spread = F.greatest(F.sqrt(F.greatest(F.col("ss") - F.col("s") * mean, F.lit(0.0)) / F.greatest(F.col("k") - 1, F.lit(1))), F.sqrt(mean))
    judged = sums.filter("k > 0").select("window_start", "event_type", "n", ((F.col("n") - mean) / spread).alias("z_score"))
    return judged.filter(F.abs("z_score") >= threshold)


def _open_outages(spark: SparkSession, folder: str, **_) -> DataFrame:
    """Intervals among the events that the watermark has not passed and the intervals that are open."""
    waiting = state_rows(spark, folder, 0, "waiting")
    entries = waiting.select("key.user_id", F.explode("user_map_value.events").alias("e")).select("user_id", "e.*")
    opened = state_rows(spark, folder, 0, "opened").select("key.user_id", "value.ts", F.lit(-1).cast("long").alias("event_id"), F.lit(True).alias("down"))
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    turns = entries.unionByName(opened).withColumn("before", F.coalesce(F.lag("down").over(by), F.lit(False))).filter("down <> before")
    ends = turns.withColumn("end_time", F.lead("ts").over(by)).filter("down AND end_time IS NOT NULL")
    length = (F.unix_micros("end_time") - F.unix_micros("ts")) / 1e6
    return ends.select("user_id", F.col("ts").alias("start_time"), "end_time", length.alias("duration_seconds"))


STILL_OPEN: dict[Callable, Callable] = {
    tumbling_counts: _open_windows, sliding_counts: _open_sliding, sessions: _open_sessions, spikes: _open_spikes, outages: _open_outages,
}
