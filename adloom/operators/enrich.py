"""Attaching ad and slot attributes to the facts.

The joins carry no hint. Spark broadcasts a dimension only while its size is known to be below
``spark.sql.autoBroadcastJoinThreshold`` (from file sizes when planning, from the measured shuffle size at run time);
a larger dimension is joined by sort-merge, where adaptive execution splits the partition of a hot ad.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.operators.clean import newest, unique_rows, valid_events
from adloom.schemas import TABLES

AD_KEYS = ["ad_id", "campaign_id"]
AD_COLUMNS = ["advertiser_id", "ad_type", "landing_type", "product_id"]
SLOT_KEYS = ["ad_slot_id"]
SLOT_COLUMNS = ["slot_type", "app", "position", "price_factor"]

# The two kinds of traffic events.
EVENT_TYPES = ("impression", "click")
EVENT_KEYS = ["dt", "event_id", "event_type"]
LEAN_COLUMNS = ["dt", "event_id", "event_type", "event_time", "user_id", "ad_id", "campaign_id"]

_DETAIL = TABLES["dwd.ad_impression_detail"].names
DETAIL_COLUMNS = [*_DETAIL[:2], "dt", *_DETAIL[2:]]


def enrich_events(events: DataFrame, ads: DataFrame, slots: DataFrame) -> DataFrame:
    """Events with ad and slot attributes; an event without a match keeps NULLs."""
    with_ad = events.join(ads.select(*AD_KEYS, *AD_COLUMNS), AD_KEYS, "left")
    return with_ad.join(slots.select(*SLOT_KEYS, *SLOT_COLUMNS), SLOT_KEYS, "left")


def enrich_conversions(conversions: DataFrame, ads: DataFrame) -> DataFrame:
    return conversions.join(ads.select(*AD_KEYS, "advertiser_id", "product_id"), AD_KEYS, "left")


def event_detail(events: DataFrame, ads: DataFrame, slots: DataFrame, event_type: str | None = None) -> DataFrame:
    """Valid events, newest copy per (dt, event_id) and type, with ad and slot attributes.

    Copies are removed before the joins: the rows that are shuffled stay narrow, and each survivor is looked up once.
    The dimensions are made unique first, so a repeated dimension key cannot multiply events. With ``event_type`` only
    that type is read; without it both detail tables come from one pass.
    """
    facts = newest(valid_events(events, event_type), EVENT_KEYS, "event_time")
    wide = enrich_events(
        facts,
        unique_rows(ads.select(*AD_KEYS, *AD_COLUMNS), AD_KEYS),
        unique_rows(slots.select(*SLOT_KEYS, *SLOT_COLUMNS), SLOT_KEYS),
    )
    return wide.where(F.col("event_type").isin(*EVENT_TYPES)).select(*DETAIL_COLUMNS)


def impression_detail(events: DataFrame, ads: DataFrame, slots: DataFrame) -> DataFrame:
    return event_detail(events, ads, slots, "impression")


def click_detail(events: DataFrame, ads: DataFrame, slots: DataFrame) -> DataFrame:
    return event_detail(events, ads, slots, "click")


def lean_traffic(events: DataFrame, ads: DataFrame) -> DataFrame:
    """Impressions and clicks with just the columns the daily metrics use.

    The tie-break of the deduplication compares every column it is given, so columns that are not needed are left out
    before it; otherwise they would all be read and shuffled.
    """
    facts = newest(valid_events(events).select(*LEAN_COLUMNS), EVENT_KEYS, "event_time")
    advertisers = unique_rows(ads.select(*AD_KEYS, "advertiser_id"), AD_KEYS)
    return facts.where(F.col("event_type").isin(*EVENT_TYPES)).join(advertisers, AD_KEYS, "left")


def conversion_detail(conversions: DataFrame, ads: DataFrame) -> DataFrame:
    """Newest copy per (dt, conv_id) with advertiser and product. Conversions carry no validity flag."""
    facts = newest(conversions, ["dt", "conv_id"], "conv_time")
    names = ["advertiser_id", "product_id"]
    wide = enrich_conversions(facts, unique_rows(ads.select(*AD_KEYS, *names), AD_KEYS))
    return wide.select(
        "conv_id", "conv_time", "dt", "user_id", "ad_id", "campaign_id", *names, "order_id", "gmv_amount"
    )
