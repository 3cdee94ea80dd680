"""Pages of a long ordered list: rows in key ranges, and a small table of fences with row counts.

The rows are sorted once into ranges of about ``rows`` rows, a folder each. The fences have a line per range: its first and last
key, its rows and the rows before it. A page by number finds its ranges by these counts, a page after a key by the fences; both
read only the folders of those ranges and sort no more than them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE, GROUP = "key_range", 1024


@dataclass(frozen=True)
class PageIndex:
    path: str
    keys: Sequence[str]

    def build(self, df: DataFrame, rows: int = 100_000) -> None:
        """Writes the ranges and their fences. ``keys`` have to be a total order, without nulls."""
        spark = df.sparkSession
        parts = max(1, math.ceil(df.count() / rows))
        ranged = df.repartitionByRange(parts, *self.keys).withColumn(RANGE, F.spark_partition_id().cast("long"))
        ranged.sortWithinPartitions(*self.keys).write.partitionBy(RANGE).parquet(f"{self.path}/rows")
        written = spark.read.schema(ranged.schema).parquet(f"{self.path}/rows")
        key = F.struct(*self.keys)
        fences = written.groupBy(RANGE).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))
        # rows before a range: inside groups of ranges, then over the groups
        grouped = fences.withColumn("g", F.expr(f"{RANGE} div {GROUP}"))
        up = W.partitionBy("g").orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
        inside = grouped.withColumn("inner", F.coalesce(F.sum("n").over(up), F.lit(0)))
        over = W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)
        outer = grouped.groupBy("g").agg(F.sum("n").alias("gn")).select("g", F.coalesce(F.sum("gn").over(over), F.lit(0)).alias("outer"))
        inside.join(outer, "g").select(RANGE, "first", "last", "n", (F.col("inner") + F.col("outer")).alias("before")).write.parquet(f"{self.path}/fences")

    def fences(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/fences")

    def _rows(self, spark: SparkSession, ranges: Sequence[int]) -> DataFrame:
        folders = [f"{self.path}/rows/{RANGE}={r}" for r in ranges]
        return spark.read.parquet(*folders)

    def count(self, spark: SparkSession) -> int:
        return self.fences(spark).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, spark: SparkSession, number: int, size: int) -> DataFrame:
        """Page ``number``, from 0 on: the rows [number * size, (number + 1) * size) in key order."""
        since, until = number * size, (number + 1) * size
        hit = self.fences(spark).filter((F.col("before") < until) & (F.col("before") + F.col("n") > since)).orderBy(RANGE).collect()
        if not hit:
            return self.empty(spark)
        return self._rows(spark, [r[RANGE] for r in hit]).orderBy(*self.keys).offset(since - hit[0]["before"]).limit(size)

    def after(self, spark: SparkSession, key: Sequence, size: int) -> DataFrame:
        """The ``size`` rows that follow a key, which need not be there."""
        names = self.fences(spark).schema["first"].dataType.names
        kinds = {f.name: f.dataType for f in self.fences(spark).schema["first"].dataType}
        mark = F.struct(*[F.lit(v).cast(kinds[n]).alias(n) for n, v in zip(names, key)])
        later = self.fences(spark).filter(F.col("last") > mark).orderBy(RANGE).select(RANGE, "n", (F.col("first") > mark).alias("whole"))
        wanted, rows = [], 0
        # a page needs the range that the key is in and as many next ones as hold its rows
        for r in later.limit(size + 1).collect():
            wanted.append(r[RANGE])
            rows += r["n"] if r["whole"] else 0
            if rows >= size:
                break
        if not wanted:
            return self.empty(spark)
        return self._rows(spark, wanted).filter(F.struct(*self.keys) > mark).orderBy(*self.keys).limit(size)

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows").drop(RANGE).limit(0)
