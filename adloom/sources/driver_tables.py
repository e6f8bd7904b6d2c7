"""The advertising inputs, derived from the star-schema tables the queries are checked on.

============== ======================================================================================================
input          rule
============== ======================================================================================================
k              integer ``k`` of the JSON in ``events.props``
event log      view and signup are impressions, click is a click, error is an invalid impression
conversions    purchase events, ``gmv_amount = value``
cost           view events, ``cost = value``; many rows per campaign and day
ad metadata    all of ``part``: one ad per part, 20 campaigns, advertiser = brand (one brand is none); some products
               blank
ad slots       all of ``nation``; events also name one slot that does not exist
user profiles  all of ``customer``
duplicates     a second copy, one minute earlier, same ``dt``, of every tenth event and conversion; of every thirtieth
               a second copy of the same time with another ad and campaign
============== ======================================================================================================
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CAMPAIGNS = 20
EVENT_TYPES = ("view", "signup", "click", "error")


# Gives a table of the star schema by name.
Tables = Callable[[str], DataFrame]


def opener(spark: SparkSession, sf_dir: str) -> Tables:
    """Opens each table once, however many inputs are derived from it."""
    return cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _choice(number: str, *values: str) -> str:
    """SQL for ``values[number % len(values)]``."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), CAST({number} % {len(values)} AS INT) + 1)"


def activity(table: Tables, *event_types: str) -> DataFrame:
    """Events of the given types with the key columns every log shares."""
    kinds = ", ".join(f"'{t}'" for t in event_types)
    return (
        table("events")
        .where(f"event_type IN ({kinds})")
        .selectExpr(
            "event_id",
            "ts",
            "CAST(CAST(ts AS DATE) AS STRING) AS dt",
            "CAST(user_id AS STRING) AS user_id",
            "event_type",
            "value",
            "CAST(get_json_object(props, '$.k') AS INT) AS k",
        )
    )


_KEYS = ["dt", "user_id", "concat('ad_', k) AS ad_id", f"concat('cmp_', k % {CAMPAIGNS}) AS campaign_id"]


def _with_copies(df: DataFrame) -> DataFrame:
    """Adds the duplicates by repeating rows in place, so the source is read once."""
    kinds = "concat(array(0), if(event_id % 10 = 0, array(1), array()), if(event_id % 30 = 7, array(2), array()))"
    aged = df.selectExpr("*", f"explode({kinds}) AS kind")
    return aged.selectExpr(
        "* EXCEPT (kind, ts, k)", "if(kind = 1, ts - INTERVAL '1' MINUTE, ts) AS ts", "if(kind = 2, k + 1, k) AS k"
    )


def event_log(table: Tables) -> DataFrame:
    """Impressions and clicks. ``session_id`` is absent, as in an older snapshot of the log."""
    device = _choice("event_id", "ios", "android", "web", "h5")
    return _with_copies(activity(table, *EVENT_TYPES)).selectExpr(
        "CAST(event_id AS STRING) AS event_id",
        "ts AS event_time",
        *_KEYS,
        "concat('creative_', k) AS creative_id",
        "concat('site_', event_id % 10) AS site_id",
        "if(event_type = 'click', 'click', 'impression') AS event_type",
        f"{device} AS device",
        "CAST(event_id % 26 AS STRING) AS ad_slot_id",
        "concat('page_', event_type) AS page_id",
        "if(event_type = 'error', 0, 1) AS is_valid",
        "concat('10.0.', event_id % 256, '.', k) AS ip",
        f"concat({device}, ' browser') AS user_agent",
    )


def conversion_log(table: Tables) -> DataFrame:
    return _with_copies(activity(table, "purchase")).selectExpr(
        "CAST(event_id AS STRING) AS conv_id",
        "ts AS conv_time",
        *_KEYS,
        "concat('ord_', event_id) AS order_id",
        "value AS gmv_amount",
    )


def cost_log(table: Tables, event_type: str = "view") -> DataFrame:
    return activity(table, event_type).selectExpr("dt", _KEYS[3], "value AS cost")


def ad_meta(table: Tables) -> DataFrame:
    return table("part").selectExpr(
        "concat('ad_', p_partkey) AS ad_id",
        f"concat('cmp_', p_partkey % {CAMPAIGNS}) AS campaign_id",
        "nullif(p_brand, 'Brand#1') AS advertiser_id",
        "p_type AS ad_type",
        f"{_choice('p_size', 'app', 'web')} AS landing_type",
        "if(p_partkey % 5 = 0, '', p_name) AS product_id",
        "'2023-12-25' AS start_dt",
        "'2024-02-05' AS end_dt",
    )


def ad_slot(table: Tables) -> DataFrame:
    return table("nation").selectExpr(
        "CAST(n_nationkey AS STRING) AS ad_slot_id",
        "n_name AS slot_type",
        "CAST(n_regionkey AS STRING) AS app",
        "lower(substring(n_name, 1, 3)) AS position",
        "CAST(80 + n_nationkey AS STRING) AS price_factor",
    )


def user_profile(table: Tables) -> DataFrame:
    return table("customer").selectExpr(
        "CAST(c_custkey AS STRING) AS user_id",
        "CAST(NULL AS STRING) AS gender",
        "CAST(c_custkey % 60 AS STRING) AS age",
        "CAST(c_nationkey AS STRING) AS region",
        "c_mktsegment AS device_type",
        "'2023-06-01' AS register_dt",
    )


def prices(table: Tables) -> DataFrame:
    """Campaign prices from all nations; those of region 0 have none and fall back to the default price."""
    return table("nation").selectExpr(
        "concat('cmp_', n_nationkey) AS campaign_id",
        "if(n_regionkey <> 0, CAST(10 + n_nationkey AS DOUBLE), NULL) AS cpm",
        "if(n_regionkey <> 0, CAST(0.5 + n_nationkey / 16 AS DOUBLE), NULL) AS cpc",
    )
