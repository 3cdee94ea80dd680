"""Helpers shared by the text operators: reading, scratch tables, ASCII case, running totals, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
NOT_BLANK = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else. Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def running_total(df: DataFrame, group: Sequence[str], buckets: Sequence[str], order: Sequence[Column], amount: str, out: str) -> DataFrame:
    """Exclusive running total of ``amount`` per group in the order of ``buckets``, then ``order``.

    Totals per bucket are cumulated first, level by level; rows are cumulated inside their bucket only. So no group,
    and not the whole table where ``group`` is empty, passes through one task as rows.
    """
    keys = [*group, *buckets]
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn(out, F.coalesce(F.sum(amount).over(so_far), F.lit(0)))
    if not buckets:
        return inside
    sums = df.groupBy(*keys).agg(F.sum(amount).alias("__sum"))
    before = f"{out}_before"
    offsets = running_total(sums, group, buckets[:-1], [F.col(buckets[-1])], "__sum", before).drop("__sum")
    return inside.join(offsets, keys).withColumn(out, F.col(out) + F.col(before)).drop(before)


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): smallest node reachable over undirected ``links`` (a, b), for every node that has a link.

    Large-star and small-star rounds on distinct edges: each round points neighbours at a local minimum, so a star of
    any size stays a list of edges and no component is gathered. Ends when the edges no longer change.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node points at the node's minimum
        large = (
            both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        # small star: smaller neighbours, and the node itself, point at the minimum
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m")), F.struct(F.col("a").alias("x"), F.col("m")))).alias("e"))
            .where("e.x <> e.m")
            .select(F.col("e.x").alias("a"), F.col("e.m").alias("b"))
            .distinct()
        )
        edges = stored(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


class Cache(dict):
    """Values of ``make`` by text, made when first asked for; two generations of ``limit`` texts, the older one is let go.

    Texts longer than ``longest`` are made anew each time, so the memory is bounded.
    """

    def __init__(self, make, limit: int, longest: int):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, text: str):
        if len(text) > self.longest:
            return self.make(text)
        if text in self.older:
            value = self.older[text]
        else:
            value = self.make(text)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[text] = value
        return value


#: Batches that go to a worker: texts are long, so few rows fill one.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def in_workers(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with small batches, after which a worker gives free memory back to the machine.

    The batch sizes are session settings; they are left alone where the session's own configuration names them.
    """
    spark = df.sparkSession
    for key, value in BATCHES.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_held: list = [None, None]


def held(key, make):
    """What ``make`` prepared for ``key`` in this worker process; only the last one is held, so its caches are all there are."""
    if _held[0] != key:
        _held[:] = [None, None]
        _held[:] = [key, make()]
    return _held[1]
