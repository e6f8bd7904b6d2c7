"""Declaring and writing Parquet tables.

Output files are sized by a rebalance on the partition column: adaptive execution merges small shuffle blocks and cuts
a day that is too large for one task into several files. A fixed number of files per day would funnel a whole day
through that many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager, nullcontext
from datetime import date
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from adloom.schemas import Table
from adloom.sources.tables import path_exists

OPEN_DAYS = 64


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def declare_table(spark: SparkSession, table: Table, location: str) -> None:
    """External Parquet table over ``location``; keeps a declaration that already exists."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.layer}")
    partition = "PARTITIONED BY (dt STRING)" if table.partitioned else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table.full_name} ({table.columns}) USING PARQUET {partition} "
        f"LOCATION {_quoted(location)}"
    )


def register_partitions(spark: SparkSession, name: str) -> None:
    """Make day directories written by path visible in the catalog."""
    spark.catalog.recoverPartitions(name)


def sized(df: DataFrame, *columns: str) -> DataFrame:
    """Even output files; rows of equal ``columns`` stay together as far as the target file size allows."""
    return df.hint("rebalance", *columns)


def conform(df: DataFrame, table: Table, *extra: str) -> DataFrame:
    """The columns of ``table`` in table order with their declared types, ``extra`` ones, and ``dt`` last where partitioned."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    return df.select(*columns, *extra, *(["dt"] if table.partitioned else []))


class Counted:
    """Rows on their way to a table, in its form and sized, with counts that are taken as they are written.

    ``measures`` are conditions on the rows of ``df``, also on columns the table does not have. They are counted behind the
    exchange that sizes the files, in the tasks that write: Spark counts those exactly once, even where a lost
    executor makes it repeat earlier stages. No second look at the data is needed.
    """

    def __init__(self, df: DataFrame, table: Table, measures: Mapping[str, Column] | None = None, by_size: bool = True):
        self.names = list(measures or {})
        flags = {f"_holds_{i}": F.coalesce(c, F.lit(False)).cast("tinyint") for i, c in enumerate((measures or {}).values())}
        rows = conform(df.withColumns(flags), table, *flags)
        if by_size:
            rows = sized(rows, *(["dt"] if table.partitioned else []))
        self._seen = Observation()
        counters = [F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in flags]
        self.rows = rows.observe(self._seen, F.count(F.lit(1)).alias("rows"), *counters).drop(*flags)

    def counts(self) -> tuple[int, dict[str, int]]:
        """Rows written, and rows for which each measure held; to be asked for after the write."""
        found = self._seen.get
        return int(found["rows"]), {name: int(found[f"_holds_{i}"]) for i, name in enumerate(self.names)}


def write_days(df: DataFrame, path: str) -> None:
    """Replace the days present in ``df``; every other day of the directory stays as it is."""
    _write_days(sized(df, "dt"), path)


def _write_days(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def insert_day(df: DataFrame, table: Table, dt: str) -> None:
    """Replace one day of a catalog table, columns in table order; an empty day empties the partition."""
    day = date.fromisoformat(dt).isoformat()
    columns = ", ".join(table.names)
    rows = sized(conform(df.where(F.col("dt") == day), table).drop("dt"))
    rows.sparkSession.sql(
        f"INSERT OVERWRITE TABLE {table.full_name} PARTITION (dt = {_quoted(day)}) SELECT {columns} FROM {{rows}}",
        rows=rows,
    )


def write_whole(df: DataFrame, table: Table, path: str, measures: Mapping[str, Column] | None = None) -> Counted:
    """Replace a whole table: the catalog table where declared (see ``swap_in``), else the directory."""
    counted = Counted(df, table, measures)
    if df.sparkSession.catalog.tableExists(table.full_name):
        swap_in(counted.rows, table, path)
    else:
        counted.rows.write.mode("overwrite").parquet(path)
    return counted


def location_of(spark: SparkSession, name: str) -> str:
    """The directory of a catalog table."""
    listed = spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:name)", args={"name": name})
    return listed.where("col_name = 'Location'").first().data_type


def swap_in(rows: DataFrame, table: Table, path: str) -> str:
    """Replace all rows of a declared table without partitions; returns the directory they were in.

    The rows are written to a directory of their own beside ``path``, and the table is pointed at it once they are
    complete. A query that has begun goes on with the files it knows, and a write that fails leaves the table as it was.
    """
    spark, before = rows.sparkSession, location_of(rows.sparkSession, table.full_name)
    aside = f"{path.rstrip('/')}__{uuid4().hex}"
    rows.write.parquet(aside)
    spark.sql(f"ALTER TABLE {table.full_name} SET LOCATION {_quoted(aside)}")
    spark.catalog.refreshTable(table.full_name)
    return before


@contextmanager
def _replacing_days_only(spark: SparkSession):
    """Inserting by name follows the session's overwrite mode alone; in static mode it would empty the whole table."""
    key, wanted = "spark.sql.sources.partitionOverwriteMode", "dynamic"
    before = spark.conf.get(key)
    spark.conf.set(key, wanted)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def _days_side_by_side(spark: SparkSession):
    """A task keeps the files of up to ``OPEN_DAYS`` days open, so its rows need no sort by day."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(OPEN_DAYS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store_days(
    df: DataFrame,
    table: Table,
    path: str,
    days: Sequence[str] = (),
    measures: Mapping[str, Column] | None = None,
    by_size: bool = True,
) -> Counted:
    """Replace the days present in ``df`` of table ``table``: by catalog name where declared, else by path.

    ``days`` are those the result is complete for: the ones it has no rows of are emptied. They are the days whose files
    are the same before and after the write, which the file listing tells without computing anything twice.

    Without ``by_size`` every task writes its rows of all days where they are: for rows that each task has many days of, such
    as snapshots, whose days would else all go through an exchange.
    """
    spark, counted = df.sparkSession, Counted(df, table, measures, by_size)
    before = _day_files(spark, path, days) if days else {}
    with nullcontext() if by_size else _days_side_by_side(spark):
        if spark.catalog.tableExists(table.full_name):
            with _replacing_days_only(spark):
                counted.rows.write.mode("overwrite").insertInto(table.full_name)
        else:
            _write_days(counted.rows, path)
    if before:
        after = _day_files(spark, path, days)
        empty_days(spark, table, path, [day for day, file in before.items() if after.get(day) == file])
    return counted


def _day_files(spark: SparkSession, path: str, days: Sequence[str]) -> dict[str, str]:
    """One data file of each of the given days that has rows; no data column is read."""
    if not path_exists(spark, path):
        return {}
    files = spark.read.schema("dt string").parquet(path).where(F.col("dt").isin(*days))
    return {r.dt: r.file for r in files.groupBy("dt").agg(F.max("_metadata.file_path").alias("file")).collect()}


def empty_days(spark: SparkSession, table: Table, path: str, days: Sequence[str]) -> None:
    """Leave the given days without rows, where they exist."""
    none = spark.createDataFrame([], table.schema)
    for day in days:
        if not path_exists(spark, f"{path}/dt={day}"):
            continue
        if spark.catalog.tableExists(table.full_name):
            insert_day(none.withColumn("dt", F.lit(day)), table, day)
        else:
            none.write.mode("overwrite").parquet(f"{path}/dt={day}")


def write_result(df: DataFrame, path: str) -> None:
    """Plain overwrite of an aggregate result."""
    df.write.mode("overwrite").parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a directory, on any file system Spark can write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
