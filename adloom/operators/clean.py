"""Standardising, filtering and deduplicating the landed logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.parsing import as_date, as_timestamp, blank_to_null

# Event columns an older log may lack, with the value they then get.
LATE_EVENT_COLUMNS = {
    "session_id": ("string", None),
    "ad_slot_id": ("string", None),
    "page_id": ("string", None),
    "is_valid": ("int", 1),
    "ip": ("string", None),
    "user_agent": ("string", None),
}

# What decides first between rows of equal key and time; the columns that narrow traffic has, too.
TIE_BREAK = ("user_id", "ad_id", "campaign_id")


def backfill(df: DataFrame, defaults: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Add each absent column with its typed default; present columns are left alone."""
    absent = {c: F.lit(value).cast(kind) for c, (kind, value) in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def _strings(*names: str) -> list[Column]:
    return [F.expr(f"CAST({n} AS STRING) AS {n}") for n in names]


def _number(name: str, kind: str) -> Column:
    return F.expr(f"try_cast({name} AS {kind}) AS {name}")


def standard_events(raw: DataFrame) -> DataFrame:
    """Event log with every column present and typed."""
    df = backfill(raw, LATE_EVENT_COLUMNS)
    return df.select(
        *_strings("event_id"),
        as_timestamp(df, "event_time").alias("event_time"),
        *_strings("dt", "user_id", "session_id", "ad_id", "campaign_id", "creative_id", "site_id", "page_id"),
        *_strings("ad_slot_id", "device", "user_agent", "ip"),
        _number("is_valid", "int"),
        *_strings("event_type"),
    )


def standard_conversions(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_strings("conv_id"),
        as_timestamp(raw, "conv_time").alias("conv_time"),
        *_strings("dt", "user_id", "ad_id", "campaign_id", "order_id"),
        _number("gmv_amount", "double"),
    )


def standard_cost(raw: DataFrame) -> DataFrame:
    return raw.select(*_strings("dt", "campaign_id"), _number("cost", "double"))


def user_dimension(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_strings("user_id", "gender"),
        _number("age", "int"),
        *_strings("region", "device_type"),
        as_date(raw, "register_dt").alias("register_dt"),
    )


def ad_dimension(raw: DataFrame) -> DataFrame:
    """One row per (ad, campaign) of the source; a blank product is NULL."""
    return raw.select(
        *_strings("ad_id", "campaign_id", "advertiser_id", "ad_type", "landing_type"),
        blank_to_null(F.col("product_id")).alias("product_id"),
        as_date(raw, "start_dt").alias("start_dt"),
        as_date(raw, "end_dt").alias("end_dt"),
    )


def slot_dimension(raw: DataFrame) -> DataFrame:
    return raw.select(
        *_strings("ad_slot_id", "slot_type", "app", "position"),
        _number("price_factor", "double"),
    )


def daily_snapshot(dimension: DataFrame, days: Sequence[str]) -> DataFrame:
    """The dimension once per day, stamped with ``dt``. One pass over the source, however many days."""
    return dimension.withColumn("dt", F.explode(F.array(*[F.lit(d) for d in days])))


def is_valid() -> Column:
    """Events without a validity flag count as valid."""
    return F.coalesce(F.col("is_valid"), F.lit(1)) == 1


def is_flagged_valid() -> Column:
    """Strict variant: an event without a validity flag is not kept."""
    return F.col("is_valid") == 1


def valid_events(events: DataFrame, event_type: str | None = None) -> DataFrame:
    kept = events.where(is_valid())
    return kept if event_type is None else kept.where(F.col("event_type") == event_type)


def newest(df: DataFrame, keys: Sequence[str], time_column: str) -> DataFrame:
    """One row per key, the one with the latest time.

    Equal times are decided by the remaining columns, so the result does not depend on how the rows were partitioned. The
    columns of ``TIE_BREAK`` come first, so narrow and wide rows of the same events are decided alike.
    ``row_number() = 1`` lets Catalyst place a group limit before the exchange as well: every map task sends at most one
    row per key, so a key that owns a large part of the input never gathers in one task.
    """
    rest = [c for c in df.columns if c not in (*keys, time_column)]
    rest.sort(key=lambda c: TIE_BREAK.index(c) if c in TIE_BREAK else len(TIE_BREAK))
    order = ", ".join(f"{c} DESC NULLS LAST" for c in (time_column, *rest))
    rank = F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order})")
    return df.withColumn("_n", rank).where("_n = 1").drop("_n")


def unique_rows(dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of a dimension that may hold repeated keys: the smallest one, compared column by column.

    Being an aggregate on the keys it also tells Catalyst that they are unique, so a left join to it disappears from
    any plan that uses none of its attributes.
    """
    rest = [c for c in dimension.columns if c not in keys]
    picked = dimension.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*keys, "_row.*")


def campaign_day_cost(cost: DataFrame) -> DataFrame:
    """One cost per campaign and day: the highest reported. Rows without a campaign are dropped.

    The cost is the only payload, so "keep the row with the highest cost" is a plain maximum with map-side combining.
    """
    return cost.where(F.col("campaign_id").isNotNull()).groupBy("dt", "campaign_id").agg(F.max("cost").alias("cost"))
