"""Daily metrics per campaign, advertiser and user.

The facts are stacked into one narrow table of (dt, key, counters) and grouped once. That needs a single exchange where
a spine of distinct keys joined to one aggregate per fact would need several, and every sum combines map-side, so a
campaign that owns a third of all events sends one row per map task.

A missing campaign or user keeps its row in the key spine, but no counter is attributed to it: it appears with zeros.
A missing advertiser is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.functions.ratios import AMOUNT, ctr, cvr, roi, rpm

COUNTERS = ["impressions", "clicks", "conversions", "gmv_amount", "cost"]


def stack(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(DataFrame.unionByName, frames)


def key_spine(key: str, *facts: DataFrame, drop_null: bool = False) -> DataFrame:
    """Distinct (dt, key) over several facts."""
    keys = stack(*[f.select("dt", key) for f in facts]).distinct()
    return keys.where(F.col(key).isNotNull()) if drop_null else keys


# Counters as they are added up: money is exact. Tables hold it as DOUBLE.
_KINDS = dict(zip(COUNTERS, ["bigint", "bigint", "bigint", AMOUNT, AMOUNT]))
_STORED = dict(zip(COUNTERS, ["bigint", "bigint", "bigint", "double", "double"]))


def traffic(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """The two detail tables as one: the columns the metrics use, told apart by ``event_type``."""
    columns = ["dt", "event_time", "user_id", "campaign_id", "advertiser_id"]
    return stack(
        impressions.select(*columns, F.lit("impression").alias("event_type")),
        clicks.select(*columns, F.lit("click").alias("event_type")),
    )


# SQL of the counters a fact row contributes to.
_TRAFFIC = {"impressions": "event_type <=> 'impression'", "clicks": "event_type <=> 'click'"}
_CONVERSION = {"conversions": "1", "gmv_amount": f"coalesce(try_cast(gmv_amount AS {AMOUNT}), 0)"}
_COST = {"cost": f"coalesce(try_cast(cost AS {AMOUNT}), 0)"}


def _counters(fact: DataFrame, keys: list[str], filled: dict[str, str]) -> DataFrame:
    """Fact rows as counter rows: the named counters filled, the others zero."""
    return fact.selectExpr(*keys, *[f"CAST({filled.get(c, '0')} AS {kind}) AS {c}" for c, kind in _KINDS.items()])


def _sums(*names: str) -> list[Column]:
    return [F.expr(f"sum({c}) AS {c}") for c in names]


def _with_rates(df: DataFrame) -> DataFrame:
    """Rates of the exact sums, then the sums in the types of the table."""
    c = F.col
    rated = df.withColumns(
        {
            "ctr": ctr(c("clicks"), c("impressions")),
            "cvr": cvr(c("conversions"), c("clicks")),
            "rpm": rpm(c("gmv_amount"), c("impressions")),
            "roi": roi(c("gmv_amount"), c("cost")),
        }
    )
    return rated.withColumns({name: c(name).cast(kind) for name, kind in _STORED.items()})


def campaign_daily(seen: DataFrame, conversions: DataFrame, cost: DataFrame) -> DataFrame:
    """Counters and rates per (dt, campaign_id).

    ``seen`` holds impressions and clicks (see ``traffic``), ``cost`` one row per campaign and day.
    """
    keys = ["dt", "campaign_id"]
    facts = stack(
        _counters(seen, keys, _TRAFFIC), _counters(conversions, keys, _CONVERSION), _counters(cost, keys, _COST)
    )
    totals = facts.groupBy(*keys).agg(*_sums(*COUNTERS))
    return _with_rates(
        totals.selectExpr(*keys, *[f"if(campaign_id IS NULL, 0, {c}) AS {c}" for c in COUNTERS])
    )


def _in_map() -> Column:
    return F.col("campaign_id").isNotNull() & F.col("advertiser_id").isNotNull()


def campaign_advertiser_map(seen: DataFrame) -> DataFrame:
    """Distinct (dt, campaign_id, advertiser_id) seen in impressions; from clicks on days whose impressions give none.

    The fallback is decided per day as a whole: a campaign with clicks only stays unmapped on a day with any mapped
    impression. Both uses of the pairs share one exchange (the filter on ``dt`` keeps them identical, as the join adds it
    to one of them), and the days are a handful of rows.
    """
    pairs = seen.where(_in_map() & F.col("dt").isNotNull()).groupBy("dt", "campaign_id", "advertiser_id").agg(
        F.expr("bool_or(event_type = 'impression') AS by_impression")
    )
    mapped_days = pairs.where("by_impression").select("dt").distinct().withColumn("mapped", F.lit(True))
    chosen = pairs.join(mapped_days, "dt", "left").where(F.col("by_impression") | F.col("mapped").isNull())
    return chosen.select("dt", "campaign_id", "advertiser_id")


def _attributed(seen: DataFrame, conversions: DataFrame | None, cost: DataFrame) -> DataFrame:
    """Counters per (dt, advertiser) with an even share of the cost of every campaign the advertiser takes part in.

    A campaign's cost is divided by the number of its advertisers; without any it stays with the NULL advertiser. The
    shares are worked out side by side for the advertisers of impressions and for those of clicks, and each day takes
    the former if its impressions name any advertiser at all. So the facts are read once, and everything after the
    first aggregate works on distinct (dt, campaign, advertiser) rows: the campaign window sees the advertisers of one
    campaign and day. ``cost`` is NULL where no cost is due.
    """
    keys = ["dt", "campaign_id", "advertiser_id"]
    spent = cost.withColumn("advertiser_id", F.lit(None).cast("string"))
    facts = [_counters(seen, keys, _TRAFFIC), _counters(spent, keys, _COST)]
    if conversions is not None:
        facts.append(_counters(conversions, keys, _CONVERSION))
    spent_rows = [F.lit(0), F.lit(1), F.lit(0)]
    cube = (
        stack(*[f.withColumn("spent", flag) for f, flag in zip(facts, spent_rows)])
        .groupBy(*keys)
        .agg(*_sums(*COUNTERS), F.max("spent").alias("spent"))
    )

    campaign = W.partitionBy("dt", "campaign_id")
    due = F.max("spent").over(campaign) == 1
    # Types that leave sixteen digits to a share, where Spark's own would leave six.
    total = F.sum("cost").over(campaign).try_cast("decimal(24, 6)")

    def share(basis: str) -> Column:
        takes_part = _in_map() & (F.col(basis) > 0)
        advertisers = F.count_if(takes_part).over(campaign)
        even = total / F.nullif(advertisers, F.lit(0)).cast("decimal(9, 0)")
        return F.when(due & takes_part, even).when(due & (advertisers == 0) & (F.col("spent") == 1), total)

    shared = cube.withColumns(
        {
            "by_impressions": share("impressions"),
            "by_clicks": share("clicks"),
        }
    )
    per_advertiser = shared.groupBy("dt", "advertiser_id").agg(
        *_sums("impressions", "clicks", "conversions", "gmv_amount", "by_impressions", "by_clicks")
    )
    # One row per day, combined map-side; gathering a day's advertisers for this would put a whole day into one task.
    days = cube.groupBy(F.col("dt").alias("day")).agg(F.bool_or(_in_map() & (F.col("impressions") > 0)).alias("mapped"))
    chosen = F.when(F.col("mapped"), F.col("by_impressions")).otherwise(F.col("by_clicks"))
    joined = per_advertiser.join(days, F.col("dt").eqNullSafe(F.col("day")))
    return joined.withColumn("cost", chosen).select("dt", "advertiser_id", *COUNTERS)


def advertiser_cost_split(seen: DataFrame, cost: DataFrame) -> DataFrame:
    """Cost per (dt, advertiser); the cost of campaigns without an advertiser is on the NULL advertiser."""
    due = _attributed(seen, None, cost).where(F.col("cost").isNotNull())
    return due.select("dt", "advertiser_id", F.col("cost").cast("double").alias("cost"))


def advertiser_daily(seen: DataFrame, conversions: DataFrame, cost: DataFrame) -> DataFrame:
    """Counters and rates per (dt, advertiser_id); cost is the evenly split campaign cost."""
    known = _attributed(seen, conversions, cost).where(F.col("advertiser_id").isNotNull())
    return _with_rates(known.withColumn("cost", F.coalesce("cost", F.lit(0))))


def user_daily(seen: DataFrame, conversions: DataFrame) -> DataFrame:
    """Activity per (dt, user_id).

    ``active_campaign_cnt`` is the larger of the distinct campaigns seen and the distinct campaigns clicked. Rows are
    first combined per (dt, user, campaign): distinct counts become plain sums, and a user with very many events is
    reduced to one row per campaign before gathering in one group.
    """
    keys = ["dt", "user_id", "campaign_id"]
    counted = ["impressions", "clicks", "conversions", "gmv_amount"]
    facts = stack(
        _counters(seen, [*keys, "event_time"], _TRAFFIC),
        _counters(conversions, [*keys, "conv_time AS event_time"], _CONVERSION),
    )
    per_campaign = facts.groupBy(*keys).agg(*_sums(*counted), F.max("event_time").alias("last_event_time"))

    campaigns = [F.expr(f"count_if(campaign_id IS NOT NULL AND {c} > 0)") for c in ("impressions", "clicks")]
    per_user = per_campaign.groupBy("dt", "user_id").agg(
        *_sums(*counted),
        F.greatest(*campaigns).alias("active_campaign_cnt"),
        F.max("last_event_time").alias("last_event_time"),
    )

    def counter(name: str, alias: str, kind: str = "BIGINT") -> str:
        return f"CAST(if(user_id IS NULL, 0, {name}) AS {kind}) AS {alias}"

    totals = per_user.selectExpr(
        "dt",
        "user_id",
        counter("impressions", "imp_cnt"),
        counter("clicks", "clk_cnt"),
        counter("conversions", "conv_cnt"),
        counter("gmv_amount", "gmv_amount", "DOUBLE"),
        counter("active_campaign_cnt", "active_campaign_cnt"),
        "if(user_id IS NULL, NULL, last_event_time) AS last_event_time",
    )
    return totals.withColumns(
        {"ctr": ctr(F.col("clk_cnt"), F.col("imp_cnt")), "cvr": cvr(F.col("conv_cnt"), F.col("clk_cnt"))}
    )


def day_totals(seen: DataFrame, conversions: DataFrame, cost: DataFrame) -> DataFrame:
    """Counters over all campaigns, and active users, per day: both from one aggregate by user, so the facts are gone through once.

    A user is active with any event or conversion, also one without campaign; a missing user counts as one. ``active`` and the counters are
    what summing ``campaign_daily`` and counting ``user_daily`` gives.
    """

    def counters(fact: DataFrame, user: str, spent: bool, filled: dict[str, str]) -> DataFrame:
        known = {c: f"if(campaign_id IS NULL, 0, CAST({e} AS {_KINDS[c]}))" for c, e in filled.items()}
        return _counters(fact, ["dt", f"{user} AS user_id", f"{spent} AS spent"], known)

    facts = stack(
        counters(seen, "user_id", False, _TRAFFIC),
        counters(conversions, "user_id", False, _CONVERSION),
        counters(cost, "CAST(NULL AS STRING)", True, _COST),
    )
    per_user = facts.groupBy("dt", "user_id", "spent").agg(*_sums(*COUNTERS))
    return per_user.groupBy("dt").agg(*_sums(*COUNTERS), F.count_if(~F.col("spent")).alias("active"))
