"""Tables of versions that share files: rows in buckets, a manifest of each version, only touched buckets written again.

A table is a folder. ``data/<write>/bucket=<b>`` holds the rows of a bucket as some version wrote them, ``versions/<n>.json`` names
the folder of every bucket in version n, with the schema. A version exists when its manifest does, which is put in place by one
rename after all data are written; so a write that fails leaves the older versions as they were, and readers of a version are
never disturbed. Where a file system's rename does not refuse an existing name, writers have to take turns; a writer that finds
its version taken raises ``VersionConflict``.

A manifest has one line per bucket, so buckets are to be counted in thousands whatever the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket"


class VersionConflict(RuntimeError):
    """Another writer has made the version that was about to be made."""


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str  # JSON, without the bucket column
    keys: list[str]
    buckets: int  # hash buckets; 0 where buckets are values of a column
    folders: dict[str, str]  # bucket -> folder below the table

    def text(self) -> str:
        return json.dumps(self.__dict__)


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that exist, ascending."""
    fs, make = _files(spark, path)
    folder = make(f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The manifest of a version, the newest one where none is given."""
    if version is None:
        found = versions(spark, path)
        if not found:
            raise FileNotFoundError(f"no version of {path}")
        version = found[-1]
    row = spark.read.text(f"{path}/versions/{version}.json", wholetext=True).first()
    return Manifest(**json.loads(row[0]))


def _commit(spark: SparkSession, path: str, made: Manifest) -> None:
    fs, make = _files(spark, path)
    final, draft = make(f"{path}/versions/{made.version}.json"), make(f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(made.text().encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise VersionConflict(f"version {made.version} of {path} exists")


def hash_bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")


def _write(df: DataFrame, path: str) -> dict[str, str]:
    """Rows with a bucket column written to a new folder: the folder of each bucket that has rows."""
    write = f"data/{uuid.uuid4().hex}"
    # rows of a bucket are brought together; small buckets share a task, a large one is split
    df.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{path}/{write}")
    fs, make = _files(df.sparkSession, path)
    names = [s.getPath().getName() for s in fs.listStatus(make(f"{path}/{write}"))]
    return {n.removeprefix(f"{BUCKET}="): f"{write}/{n}" for n in names if n.startswith(f"{BUCKET}=")}


def _create(df: DataFrame, path: str, bucket: Column, keys: Sequence[str], buckets: int) -> int:
    folders = _write(df.withColumn(BUCKET, bucket), path)
    _commit(df.sparkSession, path, Manifest(1, df.schema.json(), list(keys), buckets, folders))
    return 1


def create(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> int:
    """Version 1 of a table in hash buckets of its keys."""
    return _create(df, path, hash_bucket(keys, buckets), keys, buckets)


def create_by(df: DataFrame, path: str, bucket: Column) -> int:
    """Version 1 of a table whose buckets are the values of an expression (a day, a month) as text; it has no keys."""
    return _create(df, path, bucket.cast("string"), [], 0)


def read(spark: SparkSession, path: str, version: int | None = None, buckets: Iterable[str] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets: only their folders are read."""
    held = manifest(spark, path, version)
    wanted = held.folders if buckets is None else {b: held.folders[b] for b in buckets if b in held.folders}
    schema = T.StructType.fromJson(json.loads(held.schema))
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in sorted(wanted.values())])


def replace(df: DataFrame, path: str, base: Manifest, touched: Iterable[str]) -> int:
    """The next version after ``base``: the touched buckets hold the rows of ``df`` (with its bucket column), the others their old files."""
    written = _write(df, path)
    touched = set(touched)
    if not set(written) <= touched:
        raise ValueError(f"rows of buckets that were not touched: {sorted(set(written) - touched)[:5]}")
    folders = {b: f for b, f in base.folders.items() if b not in touched} | written
    _commit(df.sparkSession, path, Manifest(base.version + 1, base.schema, base.keys, base.buckets, folders))
    return base.version + 1


def touched_buckets(df: DataFrame) -> list[str]:
    """Distinct values of the bucket column: at most as many as a manifest has lines."""
    return sorted(r[0] for r in df.select(BUCKET).distinct().collect())


def upsert(new: DataFrame, path: str) -> int:
    """The newest version with ``new`` in place of the rows of the same keys, as the next version; without rows there is none."""
    spark = new.sparkSession
    base = manifest(spark, path)
    columns = T.StructType.fromJson(json.loads(base.schema)).names
    placed = new.select(*columns).withColumn(BUCKET, hash_bucket(base.keys, base.buckets))
    touched = touched_buckets(placed)
    if not touched:
        return base.version
    old = read(spark, path, base.version, touched).withColumn(BUCKET, hash_bucket(base.keys, base.buckets))
    kept = old.join(placed.select(*base.keys), base.keys, "left_anti").select(*columns, BUCKET)
    return replace(kept.unionByName(placed), path, base, touched)


def delete(keys: DataFrame, path: str) -> int:
    """The newest version without the rows of these keys, as the next version."""
    spark = keys.sparkSession
    base = manifest(spark, path)
    placed = keys.select(*base.keys).withColumn(BUCKET, hash_bucket(base.keys, base.buckets))
    touched = touched_buckets(placed)
    if not touched:
        return base.version
    old = read(spark, path, base.version, touched).withColumn(BUCKET, hash_bucket(base.keys, base.buckets))
    return replace(old.join(placed.select(*base.keys), base.keys, "left_anti"), path, base, touched)
