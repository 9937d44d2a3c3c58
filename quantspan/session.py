"""Session settings the transforms are tuned for, and the lineage cut they share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Prices and weights are both hashed on (panel, instrument) by their windows; the
    # join on (panel, instrument, dt) can keep that layout instead of shuffling again.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(app: str = "quantspan", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Survives the loss of executors, stops later branches from recomputing `df`, and gives
    the optimizer its true size: a small result is broadcast, a large one is not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_side(table: DataFrame) -> DataFrame:
    """A table on disk as the smaller side of a join: broadcast if its bytes allow it.

    The limit is Spark's own (spark.sql.autoBroadcastJoinThreshold) and the size that of the
    optimizer's statistics. Said explicitly because the other side of these joins is a
    generator, whose size the optimizer takes for that of its few seeds.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= broadcast_limit(table.sparkSession) else table.hint("merge")


def broadcast_limit(spark: SparkSession) -> int:
    """spark.sql.autoBroadcastJoinThreshold in bytes."""
    text = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")).strip().lower()
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", text).groups()
    return int(number) * 1024 ** " kmgt".index(unit or " ")
