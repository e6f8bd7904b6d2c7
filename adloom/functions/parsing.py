"""Type standardisation that never aborts a job.

ANSI mode makes a bad cast or an unparsable date raise; raw logs contain both, so a value that does not parse becomes
NULL here and is counted by the quality operators instead. Values that already have the wanted type pass through,
which keeps fractional seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text formats of the raw logs.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
DAY_FORMAT = "yyyy-MM-dd"


def as_timestamp(df: DataFrame, name: str) -> Column:
    if is_time_type(df, name):
        return F.col(name)
    return F.expr(f"try_to_timestamp(CAST({name} AS STRING), '{TIME_FORMAT}')")


def as_date(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.DateType) or is_time_type(df, name):
        return F.col(name).cast("date")
    return F.expr(f"CAST(try_to_timestamp(CAST({name} AS STRING), '{DAY_FORMAT}') AS DATE)")


def blank_to_null(column: Column) -> Column:
    return F.nullif(column.cast("string"), F.lit(""))


def is_time_type(df: DataFrame, name: str) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType))
