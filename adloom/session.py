"""Spark session with the settings the operators are designed for."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

# Behaviour a user of the daily tables relies on.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shuffles start with many partitions and adaptive execution merges those that turn out small.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000",
    "spark.sql.session.timeZone": "Asia/Shanghai",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A dimension below this size is broadcast; a larger one is joined by shuffling.
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    # dt stays the string it is declared as; inference would turn it into a DATE.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def build_session(
    app_name: str,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: Mapping[str, object] | None = None,
) -> SparkSession:
    """Session for batch runs. ``master`` is for local use; on a cluster the launcher sets it.

    ``shuffle_partitions`` is the number of partitions a shuffle starts with: about the bytes shuffled divided by 128 MB,
    so many thousands for a day of terabytes, and the number of cores on one machine. Adaptive execution merges the
    partitions that turn out small, so it is better chosen too high than too low.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or the session's warehouse where that is not set.

    A warehouse on the driver's own disk serves only a local session; on a cluster it is refused, as no executor could read back
    what another has written there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    master = spark.sparkContext.master
    if warehouse.startswith("file:") and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is a local one")
    return warehouse.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for intermediate tables below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
