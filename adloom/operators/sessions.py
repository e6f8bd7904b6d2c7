"""Sessions: consecutive events of a user on a day, no more than ``gap_minutes`` apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: idle minutes that end a session when exceeded.
GAP_MINUTES = 30


def _seconds(df: DataFrame, time: str) -> Column:
    """Whole seconds on a linear clock: epoch seconds, or wall-clock seconds for a time without zone."""
    t = F.col(time)
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("bigint")
        return days * F.lit(86400) + F.hour(t) * F.lit(3600) + F.minute(t) * F.lit(60) + F.second(t)
    return F.unix_seconds(t)


def sessionize(
    events: DataFrame,
    time: str = "event_time",
    user: str = "user_id",
    gap_minutes: int = GAP_MINUTES,
    first_number: int = 1,
) -> DataFrame:
    """Adds ``session_id`` = ``sess_<yyyymmdd>_<user>_<number>``, numbered per (dt, user).

    The day is cut into slices as long as the gap. Two events of one slice are less than a gap apart, so a session can
    only begin at the first event of a slice, and all events of a slice share a session. It is enough to know the first
    and last time per (dt, user, slice): an aggregate with map-side combining, at most a few dozen rows per user and
    day. Ordering a user's whole day in one task is never needed, however many events the user has; the numbers are
    attached by a join on (dt, user, slice), where adaptive execution splits a hot slice.

    Numbers start at ``first_number`` and take at least three digits. Events without a time or user get no session.
    """
    keys = ["dt", user, "_slice"]
    sliced = events.withColumn("_slice", F.floor(_seconds(events, time) / F.lit(gap_minutes * 60)))
    bounds = (
        sliced.where(F.col("_slice").isNotNull())
        .groupBy(*keys)
        .agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    )
    in_order = W.partitionBy("dt", user).orderBy("_slice")
    idle_since = F.lag("_last").over(in_order)
    starts = idle_since.isNull() | (F.col("_first") > idle_since + F.expr(f"INTERVAL {int(gap_minutes)} MINUTE"))
    number = F.sum(F.col("_starts").cast("int")).over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow))
    session_id = F.concat(
        F.lit("sess_"),
        F.replace(F.col("dt"), F.lit("-"), F.lit("")),
        F.lit("_"),
        F.col(user).cast("string"),
        F.lit("_"),
        F.lpad(F.col("_number").cast("string"), F.greatest(F.lit(3), F.length(F.col("_number").cast("string"))), F.lit("0")),
    )
    numbered = (
        bounds.withColumn("_starts", starts)
        .withColumn("_number", number + F.lit(first_number - 1))
        .select(*keys, session_id.alias("session_id"))
    )
    return sliced.drop("session_id").join(numbered, keys, "left").drop("_slice")
