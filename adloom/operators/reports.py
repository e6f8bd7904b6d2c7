"""Daily reports over the metric tables, and the lookups a reader runs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.functions.ratios import ctr, cvr, growth_rate, money, money_ratio, roi, rpm, spend_flag, stable_round
from adloom.operators.metrics import day_totals
from adloom.sources.tables import last_days, one_day

_COUNTS = ["impressions", "clicks", "conversions"]


def _rounded(name: str, alias: str | None = None) -> Column:
    return stable_round(F.col(name).cast("double")).alias(alias or name)


def _totals() -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in _COUNTS] + [_rounded("gmv_amount", "gmv"), _rounded("cost")]


def kpi_overview(campaign_daily: DataFrame, user_daily: DataFrame) -> DataFrame:
    """One row per day: totals over campaigns, rates of the totals, revenue per active user. From stored daily tables."""
    totals = campaign_daily.groupBy("dt").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in _COUNTS], *[F.sum(money(F.col(c))).alias(c) for c in ("gmv_amount", "cost")]
    )
    active = user_daily.groupBy("dt").agg(F.count(F.lit(1)).alias("active"))
    return _overview(totals.join(active, "dt", "left"))


def kpi_overview_of_facts(seen: DataFrame, conversions: DataFrame, cost: DataFrame) -> DataFrame:
    """``kpi_overview`` straight from the facts, which are gone through once (see ``metrics.day_totals``)."""
    return _overview(day_totals(seen, conversions, cost))


def _overview(totals: DataFrame) -> DataFrame:
    c = F.col
    return totals.select(
        "dt",
        *_COUNTS,
        _rounded("gmv_amount", "gmv"),
        _rounded("cost"),
        ctr(c("clicks"), c("impressions")).alias("ctr"),
        cvr(c("conversions"), c("clicks")).alias("cvr"),
        rpm(c("gmv_amount"), c("impressions")).alias("rpm"),
        money_ratio(c("gmv_amount"), c("active")).alias("arpu"),
        F.coalesce("active", F.lit(0).cast("bigint")).alias("active_users"),
        roi(c("gmv_amount"), c("cost")).alias("roi"),
    )


def campaign_ranking(campaign_daily: DataFrame) -> DataFrame:
    """Rank of every campaign within its day by revenue and by return, on the rounded values; ties by id.

    Both windows share one exchange. A window group is the campaigns of a day, already one row each.
    """
    rows = campaign_daily.select("dt", "campaign_id", *_totals(), *[_rounded(c) for c in ("ctr", "cvr", "rpm", "roi")])
    day = W.partitionBy("dt")
    by_id = F.col("campaign_id").asc()
    return rows.withColumns(
        {
            "rank_by_gmv": F.row_number().over(day.orderBy(F.col("gmv").desc(), by_id)),
            "rank_by_roi": F.row_number().over(day.orderBy(F.col("roi").desc(), by_id)),
        }
    )


def advertiser_dashboard(advertiser_daily: DataFrame, dt: str | None = None) -> DataFrame:
    """Advertiser metrics with the revenue growth against the previous calendar day and the spend flag.

    The previous row of the advertiser counts only if it is exactly one day older. With ``dt``, two days are read.
    """
    df = advertiser_daily if dt is None else last_days(advertiser_daily, dt, 2)
    history = W.partitionBy("advertiser_id").orderBy("dt")
    gmv = F.col("gmv_amount").cast("double")
    day_before = F.date_sub(F.col("dt").cast("date"), 1).cast("string")
    previous = F.when(F.lag("dt").over(history) == day_before, F.lag(gmv).over(history))
    rows = df.withColumn("_previous", previous)
    if dt is not None:
        rows = one_day(rows, dt)
    return rows.select(
        "dt",
        "advertiser_id",
        *_totals(),
        *[_rounded(c) for c in ("ctr", "cvr", "roi")],
        growth_rate(gmv, F.col("_previous")).alias("revenue_growth_rate"),
        spend_flag(F.col("cost")).alias("retention_flag"),
    )


def tag_effectiveness(tag_quality: DataFrame) -> DataFrame:
    return tag_quality.select(
        "dt",
        "tag_name",
        _rounded("coverage_rate"),
        F.col("tagged_user_cnt").cast("bigint").alias("tagged_user_cnt"),
        *[_rounded(f"avg_{m}_tagged") for m in ("ctr", "cvr", "gmv")],
    )


def kpi_on(overview: DataFrame, dt: str) -> DataFrame:
    return one_day(overview, dt)


def top_campaigns(ranking: DataFrame, dt: str, n: int = 10, by: str = "gmv") -> DataFrame:
    """The ``n`` best campaigns of a day by ``gmv`` or ``roi``."""
    return one_day(ranking, dt).orderBy(f"rank_by_{by}").limit(n)


def top_advertisers(dashboard: DataFrame, dt: str, n: int = 10) -> DataFrame:
    """The ``n`` advertisers with most revenue on a day; ties by id."""
    return one_day(dashboard, dt).orderBy(F.col("gmv").desc(), "advertiser_id").limit(n)


def tags_by_coverage(effectiveness: DataFrame, dt: str) -> DataFrame:
    return one_day(effectiveness, dt).orderBy(F.col("coverage_rate").desc(), "tag_name")
