"""What several operators need: stored intermediate tables, row keys and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.session import shared_folder

NO_ID = -(1 << 63)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from files that outlive an executor.

    The shuffle files of the write are of no use once it has ended, and Spark is told to remove them then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """(k1, k2, id, text): the id, a hash that separates rows with the same id, and the text with null as empty.

    Rows equal in id and text are the same document listed twice; they share a key. Columns to ``carry`` follow, with a
    prefix that keeps their names apart.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(c).alias(f"carry_{c}") for c in carry]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *kept)
    return rows.select(F.coalesce("id", F.lit(NO_ID)).alias("k1"), F.xxhash64("id", "text").alias("k2"), *rows.columns)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (u, v); the component is its smallest node.

    Alternating large-star and small-star steps: each hangs the neighbours of a node on the smallest of them, so paths
    halve and a hub costs one aggregated row per task. Every round is stored; the number of rounds is logarithmic.
    """
    both = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = stored(both, "edges")
    mark = _mark(current)
    while True:
        mirrored = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = mirrored.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = mirrored.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(current)
        if mark == before:
            break
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def utf8(column: str = "text") -> Column:
    """A string column as bytes, which Arrow hands to Python without decoding."""
    return F.col(column).cast("binary").alias(column)
