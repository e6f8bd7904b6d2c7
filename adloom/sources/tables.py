"""Reading Parquet tables: by path, by catalog name, by day."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet directory; a missing path is an error. A ``dt`` partition column is always a string."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no Parquet table at {path}") from error
        raise
    if "dt" in df.columns and df.schema["dt"].dataType.typeName() != "string":
        df = df.withColumn("dt", F.col("dt").cast("string"))
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a directory is there, on any file system Spark can read; its files are not opened."""
    try:
        spark.read.schema("dt string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Catalog table ``name`` where it is declared, else the Parquet directory ``path``."""
    return spark.table(name) if spark.catalog.tableExists(name) else read_parquet(spark, path)


def one_day(df: DataFrame, dt: str) -> DataFrame:
    """Rows of one day. On a table partitioned by ``dt`` this prunes to a single directory."""
    return df.where(F.col("dt") == dt)


def day_window(dt: str, days: int = 7) -> tuple[str, str]:
    """First and last day of the ``days`` calendar days ending at ``dt``."""
    last = date.fromisoformat(dt)
    return (last - timedelta(days=days - 1)).isoformat(), last.isoformat()


def days_between(first: str, last: str) -> list[str]:
    """All calendar days from ``first`` to ``last``."""
    start = date.fromisoformat(first)
    return [(start + timedelta(days=i)).isoformat() for i in range((date.fromisoformat(last) - start).days + 1)]


def last_days(df: DataFrame, dt: str, days: int = 7) -> DataFrame:
    """Rows of the ``days`` days ending at ``dt``; a range on the partition column, so other days are never listed."""
    first, last = day_window(dt, days)
    return df.where(F.col("dt").between(first, last))


def first_nonempty(candidates: Iterable[DataFrame], dt: str) -> DataFrame:
    """The first candidate that has a row for ``dt``, narrowed to that day; an error if none has.

    Each probe stops at the first row it finds and reads one day only.
    """
    for candidate in candidates:
        day = one_day(candidate, dt)
        if not day.isEmpty():
            return day
    raise LookupError(f"no source has rows for dt={dt}")


def first_nonempty_source(spark: SparkSession, sources: Iterable[tuple[str, str]], dt: str) -> DataFrame:
    """``first_nonempty`` over (catalog kind, location) pairs: ``("table", name)`` or ``("path", directory)``.

    A source that does not exist, or a declared location without data files yet, counts as empty.
    """

    def opened():
        for kind, location in sources:
            try:
                if kind == "path":
                    yield read_parquet(spark, location)
                elif spark.catalog.tableExists(location):
                    yield spark.table(location)
            except FileNotFoundError:
                continue
            except AnalysisException as error:
                if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                    raise

    return first_nonempty(opened(), dt)


def days_present(df: DataFrame) -> DataFrame:
    """The distinct ``dt`` values, sorted. Only the partition column is read."""
    return df.select("dt").where(F.col("dt").isNotNull()).distinct().orderBy("dt")


def table_days(spark: SparkSession, name: str) -> DataFrame:
    """The days of a catalog table, from partition metadata alone."""
    listed = spark.sql("SHOW PARTITIONS IDENTIFIER(:name)", args={"name": name})
    return listed.select(F.split_part("partition", F.lit("="), F.lit(2)).alias("dt")).orderBy("dt")


def partition_days(spark: SparkSession, name: str, path: str) -> list[str]:
    """The days of a table, sorted: from the catalog where it is declared, else from the names of its directories.

    No file is opened or even listed, and no job runs. A day that has been emptied is still a partition.
    """
    if spark.catalog.tableExists(name):
        return [r.dt for r in table_days(spark, name).collect()]
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/dt=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(status.getPath().getName().removeprefix("dt=") for status in found)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Per day of a directory: its files with rows, their rows and their bytes. Only file metadata is read."""
    files = spark.read.schema("dt string").parquet(path).groupBy("dt", "_metadata.file_path").agg(
        F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("size")
    )
    return files.groupBy("dt").agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("row_cnt"), F.sum("size").alias("bytes"), F.max("size").alias("largest_file")
    )
