"""Profiles of the raw logs: traffic counts, media cost, device preference, product distribution, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.functions.labels import APP_DEVICES, WEB, device_type
from adloom.functions.ratios import safe_ratio

# Price of a campaign without a price entry.
DEFAULT_CPM = 30.0
DEFAULT_CPC = 1.0


def traffic_counts(events: DataFrame) -> DataFrame:
    """Impressions and clicks per (dt, campaign_id), zero where a campaign has only the other kind.

    The counts of both kinds come from one conditional aggregate, which is the full outer join of the two count tables
    without the join.
    """
    known = F.col("dt").isNotNull() & F.col("campaign_id").isNotNull()
    kept = events.where(known & F.col("event_type").isin("impression", "click"))
    return kept.groupBy("dt", "campaign_id").agg(
        F.count_if(F.col("event_type") == "impression").alias("impressions"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
    )


def media_cost(counts: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per (dt, campaign): price per thousand impressions plus price per click, never negative, in order."""
    cpm = F.coalesce("cpm", F.lit(DEFAULT_CPM))
    cpc = F.coalesce("cpc", F.lit(DEFAULT_CPC))
    cost = F.col("impressions") * cpm / F.lit(1000.0) + F.col("clicks") * cpc
    priced = counts.join(prices.select("campaign_id", "cpm", "cpc"), "campaign_id", "left")
    return priced.select(
        "dt", "campaign_id", F.round(F.greatest(F.lit(0.0), cost), 4).alias("cost")
    ).orderBy("dt", "campaign_id")


def user_device_preference(events: DataFrame) -> DataFrame:
    """The device type a user was seen with most often; equal counts go to the first in alphabetical order.

    There are three types, so the mode is a comparison of three counters that combine map-side.
    """
    kinds = sorted([*APP_DEVICES, WEB])
    counts = (
        events.select("user_id", device_type(F.col("device")).alias("kind"))
        .where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    )
    top = F.greatest(*kinds)
    preferred = F.coalesce(*[F.when(F.col(k) == top, F.lit(k)) for k in kinds])
    return counts.select("user_id", preferred.alias("device_type"))


def dataset_summary(events: DataFrame, conversions: DataFrame, hot_campaign: str) -> DataFrame:
    """One row: volume, rates, the share of impressions on ``hot_campaign``, and distinct users, ads and campaigns."""
    impression = F.col("event_type") == "impression"
    seen = events.agg(
        F.count(F.lit(1)).alias("event_rows"),
        F.count_if(impression).alias("impressions"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count_if(impression & (F.col("campaign_id") == hot_campaign)).alias("hot"),
        F.count_distinct("user_id").alias("distinct_users"),
        F.count_distinct("ad_id").alias("distinct_ads"),
        F.count_distinct("campaign_id").alias("distinct_campaigns"),
    )
    converted = conversions.agg(F.count(F.lit(1))).scalar()
    c = F.col
    return seen.withColumn("conversions", converted).select(
        "event_rows",
        "impressions",
        "clicks",
        safe_ratio(c("clicks"), c("impressions")).alias("ctr"),
        "conversions",
        safe_ratio(c("conversions"), c("clicks")).alias("cvr"),
        safe_ratio(c("hot"), c("impressions")).alias("hot_share"),
        "distinct_users",
        "distinct_ads",
        "distinct_campaigns",
    )


def product_distribution(ads: DataFrame, listed: int = 10, wide: int = 100) -> DataFrame:
    """The ``listed`` most advertised products with counts, beside the overall numbers.

    Shares are relative to all ads with a product: of the ``listed`` and of the ``wide`` most frequent products. The
    most frequent products are found by a distributed top-k; only those ``wide`` rows are ranked.
    """
    counts = (
        ads.where(F.coalesce("product_id", F.lit("")) != "")
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("product_cnt"))
    )
    overall = counts.agg(F.sum("product_cnt").alias("total"), F.count(F.lit(1)).alias("distinct"))
    top = counts.orderBy(F.col("product_cnt").desc(), "product_id").limit(wide)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.col("product_cnt").desc(), "product_id")))
    everything = W.partitionBy()
    in_list = F.when(F.col("rank") <= listed, F.col("product_cnt"))
    return (
        ranked.withColumns(
            {
                "total_nonempty": overall.select("total").scalar(),
                "distinct_products": overall.select("distinct").scalar(),
                "listed_cnt": F.sum(in_list).over(everything),
                "wide_cnt": F.sum("product_cnt").over(everything),
            }
        )
        .where(F.col("rank") <= listed)
        .select(
            "rank",
            "product_id",
            "product_cnt",
            "total_nonempty",
            "distinct_products",
            safe_ratio(F.col("listed_cnt"), F.col("total_nonempty")).alias("top_share"),
            safe_ratio(F.col("wide_cnt"), F.col("total_nonempty")).alias("wide_share"),
        )
    )
