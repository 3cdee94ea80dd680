"""Session settings shared by tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "aislecast", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("AISLECAST_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: What one task reads. A row of an aggregate with many columns takes about forty times its shuffled bytes in memory, so a quarter of Spark's own shares.
SHARES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.files.maxPartitionBytes": "32m"}
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PER_SCAN = 12  # shuffle partitions for each part of the scan, joined again where they are small


def bound_shares(spark: SparkSession) -> None:
    """Bounds what a task reads, whatever the size of the tables.

    The shares are session settings; they are left alone where the session's own configuration names them.
    """
    for key, value in SHARES.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)


def deal_shuffles(spark: SparkSession, scans: int) -> None:
    """Shuffle partitions in proportion to a scan of ``scans`` parts, once it has more than two for each core; fewer are left as they are set."""
    if spark.sparkContext.getConf().contains(INITIAL):
        return
    wanted = PER_SCAN * scans if scans > 2 * spark.sparkContext.defaultParallelism else 0
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL, str(wanted))
    else:
        spark.conf.unset(INITIAL)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's setting, or a fresh folder where none is set."""
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="aislecast-ckpt-")
    spark.sparkContext.setCheckpointDir(shared)
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again, of the size of its files.

    A checkpoint keeps the estimate of its plan. That of a join is the product of its sides, so rounds of joins would give it more
    digits each round than the driver can hold.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
