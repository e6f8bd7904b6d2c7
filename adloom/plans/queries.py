"""The registered queries: every operator applied to whole tables of the star schema.

Each query takes ``(spark, sf_dir)``. Times and dates are shown as text and arrays as comma-separated text, so that the
results compare across engines; float sums are rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.functions import labels
from adloom.functions.parsing import DAY_FORMAT
from adloom.operators import clean, enrich, metrics, profile, quality, reports, sessions, skew, tags
from adloom.schemas import CSV_SCHEMAS
from adloom.session import scratch_dir
from adloom.sources import driver_tables, landing, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]

# The day the one-day reports are asked for.
DAY = "2024-01-30"
# Tag limits that fire on the sparse check data, where a user has few impressions.
SCALED = tags.Thresholds(ctr_impressions=10, cvr_clicks=5, day_impressions=3)
SKEW_KEYS = 20
HOT = "hot"
# Campaigns with this share of the events are salted.
HOT_SHARE = 0.05
# Partitions of the placement by MD5 bucket.
PLACES = 16

REGISTRY: dict[str, Query] = {}


def show(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Comparable form: text for times, dates and arrays; doubles rounded to ``digits`` where given."""
    shown = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            shown.append(f"date_format({f.name}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS {f.name}")
        elif isinstance(f.dataType, T.DateType):
            shown.append(f"CAST({f.name} AS STRING) AS {f.name}")
        elif isinstance(f.dataType, T.ArrayType):
            shown.append(f"array_join({f.name}, ',') AS {f.name}")
        elif digits is not None and isinstance(f.dataType, T.DoubleType):
            shown.append(f"round({f.name}, {digits}) AS {f.name}")
        else:
            shown.append(f.name)
    return df.selectExpr(*shown)


class Layers:
    """The layers derived from one set of input tables; every member is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.tables = driver_tables.opener(spark, sf_dir)

    def raw(self, name: str) -> DataFrame:
        source = {
            "events": driver_tables.event_log,
            "conversions": driver_tables.conversion_log,
            "cost": driver_tables.cost_log,
            "ads": driver_tables.ad_meta,
            "slots": driver_tables.ad_slot,
            "users": driver_tables.user_profile,
            "prices": driver_tables.prices,
        }[name]
        return source(self.tables)

    @cached_property
    def events(self) -> DataFrame:
        return clean.standard_events(self.raw("events"))

    @cached_property
    def conversions(self) -> DataFrame:
        return clean.standard_conversions(self.raw("conversions"))

    @cached_property
    def cost(self) -> DataFrame:
        return clean.standard_cost(self.raw("cost"))

    @cached_property
    def ads(self) -> DataFrame:
        return clean.ad_dimension(self.raw("ads"))

    @cached_property
    def slots(self) -> DataFrame:
        return clean.slot_dimension(self.raw("slots"))

    @cached_property
    def impressions(self) -> DataFrame:
        return enrich.impression_detail(self.events, self.ads, self.slots)

    @cached_property
    def clicks(self) -> DataFrame:
        return enrich.click_detail(self.events, self.ads, self.slots)

    @cached_property
    def converted(self) -> DataFrame:
        return enrich.conversion_detail(self.conversions, self.ads)

    @cached_property
    def traffic(self) -> DataFrame:
        return enrich.lean_traffic(self.events, self.ads)

    @cached_property
    def day_cost(self) -> DataFrame:
        return clean.campaign_day_cost(self.cost)

    @cached_property
    def campaign_daily(self) -> DataFrame:
        return metrics.campaign_daily(self.traffic, self.converted, self.day_cost)

    @cached_property
    def advertiser_daily(self) -> DataFrame:
        return metrics.advertiser_daily(self.traffic, self.converted, self.day_cost)

    @cached_property
    def user_daily(self) -> DataFrame:
        return metrics.user_daily(self.traffic, self.converted)

    @cached_property
    def snapshot(self) -> DataFrame:
        return tags.user_tag_snapshot(self.user_daily)

    @cached_property
    def scaled_snapshot(self) -> DataFrame:
        return tags.user_tag_snapshot(self.user_daily, thresholds=SCALED)

    @cached_property
    def tag_quality(self) -> DataFrame:
        return tags.tag_quality_daily(self.snapshot)

    @cached_property
    def scaled_tag_quality(self) -> DataFrame:
        return tags.tag_quality_daily(self.scaled_snapshot)

    @cached_property
    def overview(self) -> DataFrame:
        return reports.kpi_overview_of_facts(self.traffic, self.converted, self.day_cost)

    @cached_property
    def ranking(self) -> DataFrame:
        return reports.campaign_ranking(self.campaign_daily)

    @cached_property
    def dashboard(self) -> DataFrame:
        return reports.advertiser_dashboard(self.advertiser_daily)

    @cached_property
    def sequence(self):
        return F.col("event_id").cast("bigint")

    @cached_property
    def hot(self) -> dict[str, int]:
        return skew.found_buckets(skew.hot_buckets(self.events, min_share=HOT_SHARE))

    @cached_property
    def skewed(self) -> DataFrame:
        return skew.rekey_skewed(self.events, self.sequence, SKEW_KEYS, hot_key=HOT)


def register(name: str, digits: int | None = None):
    def wrap(build: Callable[[Layers], DataFrame]):
        REGISTRY[name] = lambda spark, sf_dir: show(build(Layers(spark, sf_dir)), digits)
        return build

    return wrap


# ---------------------------------------------------------------- sources and sinks


def through_csv(layers: Layers, raw: DataFrame, source: str) -> DataFrame:
    """``raw`` as CSV lines in the raw layout of ``source``, read with its schema and given its types; no file is written."""
    layout = T.StructType.fromDDL(CSV_SCHEMAS[source])
    text = []
    for f in layout.fields:
        if f.name not in raw.columns:
            c = F.lit(None).cast(f.dataType)
        elif isinstance(raw.schema[f.name].dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(raw.schema[f.name].dataType, T.DateType):
            c = F.date_format(f.name, DAY_FORMAT)
        else:
            c = F.col(f.name).cast(f.dataType)
        text.append(c.alias(f.name))
    line = F.to_csv(F.struct(*text))
    return landing.TYPERS[source](raw.select(F.from_csv(line, CSV_SCHEMAS[source]).alias("c")).select("c.*"))


register("land_events")(lambda x: through_csv(x, x.raw("events"), "ad_event_log"))
register("land_conversions")(lambda x: through_csv(x, x.raw("conversions"), "conversion_log"))
register("land_cost")(lambda x: through_csv(x, x.raw("cost"), "ad_cost"))
register("land_user_profile")(lambda x: through_csv(x, x.raw("users"), "user_profile"))
register("land_ad_meta")(lambda x: through_csv(x, x.raw("ads"), "ad_meta"))
register("land_ad_slot")(lambda x: through_csv(x, x.raw("slots"), "ad_slot"))


@register("first_nonempty_cost")
def _first_nonempty_cost(x: Layers) -> DataFrame:
    """The first source, cost of refunds, has no rows, which only a look at the data tells."""
    refunds = clean.campaign_day_cost(clean.standard_cost(driver_tables.cost_log(x.tables, "refund")))
    return tables.first_nonempty([refunds, x.day_cost], DAY)


register("day_scan")(lambda x: tables.one_day(x.events, DAY))
register("last7_scan")(lambda x: tables.last_days(x.events, DAY))
register("discover_dts")(lambda x: tables.days_present(x.events))


@register("overwrite_day")
def _overwrite_day(x: Layers) -> DataFrame:
    path = scratch_dir(x.spark, "campaign_day_cost")
    sinks.write_days(x.day_cost, path)
    again = tables.one_day(x.day_cost, DAY).withColumn("cost", F.col("cost") * 2)
    sinks.write_days(again, path)
    return tables.read_parquet(x.spark, path).select("dt", "campaign_id", "cost")


# ---------------------------------------------------------------- cleaning

register("std_events")(lambda x: x.events)
register("std_conversions")(lambda x: x.conversions)
register("std_cost")(lambda x: x.cost)
register("dim_user")(lambda x: clean.user_dimension(x.raw("users")))
register("dim_ad")(lambda x: x.ads)
register("dim_ad_slot")(lambda x: x.slots)
register("dim_snapshot")(lambda x: clean.daily_snapshot(x.ads, ["2024-01-29", DAY]))


@register("backfill_columns")
def _backfill_columns(x: Layers) -> DataFrame:
    older = x.raw("events").drop(*clean.LATE_EVENT_COLUMNS)
    return clean.backfill(older, clean.LATE_EVENT_COLUMNS)


@register("valid_events")
def _valid_events(x: Layers) -> DataFrame:
    unflagged = F.when(F.col("event_type") != "click", F.col("is_valid"))
    return clean.valid_events(x.events.withColumn("is_valid", unflagged))


@register("device_type")
def _device_type(x: Layers) -> DataFrame:
    kind = labels.device_type(F.col("device"))
    return x.events.select("event_id", "event_time", "device", kind.alias("device_type")).withColumn(
        "agent", labels.user_agent_label(F.col("device_type"))
    )


@register("md5_bucket")
def _md5_bucket(x: Layers) -> DataFrame:
    return x.events.select(
        "event_id",
        "event_time",
        "ad_id",
        labels.md5_bucket(F.col("ad_id"), 50).alias("bucket"),
        labels.md5_advertiser(F.col("campaign_id")).alias("advertiser"),
    )


# ---------------------------------------------------------------- enrichment and detail tables

register("enrich_events")(lambda x: enrich.enrich_events(x.events, x.ads, x.slots))
register("enrich_conversions")(lambda x: enrich.enrich_conversions(x.conversions, x.ads))
register("impression_detail")(lambda x: x.impressions)
register("click_detail")(lambda x: x.clicks)
register("conversion_detail")(lambda x: x.converted)
register("campaign_day_cost")(lambda x: x.day_cost)

# ---------------------------------------------------------------- daily metrics

register("campaign_spine")(
    lambda x: metrics.key_spine("campaign_id", x.traffic, x.converted, x.day_cost)
)
register("advertiser_spine")(
    lambda x: metrics.key_spine("advertiser_id", x.traffic, x.converted, drop_null=True)
)
register("user_spine")(lambda x: metrics.key_spine("user_id", x.traffic, x.converted))
register("event_union")(lambda x: enrich.event_detail(x.events, x.ads, x.slots))
register("campaign_advertiser_map")(lambda x: metrics.campaign_advertiser_map(x.traffic))
register("advertiser_cost_split", 6)(lambda x: metrics.advertiser_cost_split(x.traffic, x.day_cost))
register("campaign_daily", 6)(lambda x: x.campaign_daily)
register("advertiser_daily", 6)(lambda x: x.advertiser_daily)
register("user_daily", 6)(lambda x: x.user_daily)
register("imp_click_full_outer")(lambda x: profile.traffic_counts(x.events))
register("media_cost")(lambda x: profile.media_cost(profile.traffic_counts(x.events), x.raw("prices")))

# ---------------------------------------------------------------- tags

register("user_features_7d", 6)(lambda x: tags.user_features(x.user_daily))
register("user_features_day", 6)(lambda x: tags.user_features_on(x.user_daily, DAY))
register("user_tag_snapshot", 6)(lambda x: x.snapshot)
register("user_tag_snapshot_scaled", 6)(lambda x: x.scaled_snapshot)
register("user_tag_snapshot_day", 6)(lambda x: tags.user_tag_snapshot(x.user_daily, DAY))
register("tag_explode", 6)(lambda x: tags.tag_rows(x.scaled_snapshot))
register("tag_quality_daily", 9)(lambda x: x.tag_quality)
register("tag_quality_scaled", 9)(lambda x: x.scaled_tag_quality)


@register("tag_dict")
def _tag_dict(x: Layers) -> DataFrame:
    """The dictionary with the number of user-days that carry each tag."""
    carried = tags.tag_rows(x.scaled_snapshot).groupBy("tag_name").agg(F.count(F.lit(1)).alias("n"))
    dictionary = tags.tag_dictionary(x.spark).drop("create_time")
    return dictionary.join(carried, "tag_name", "left").select(
        *dictionary.columns, F.coalesce("n", F.lit(0)).alias("tagged_user_days")
    )


# ---------------------------------------------------------------- reports

register("kpi_overview", 6)(lambda x: x.overview)
register("campaign_ranking", 6)(lambda x: x.ranking)
register("advertiser_dashboard", 6)(lambda x: x.dashboard)
register("tag_effectiveness", 6)(lambda x: reports.tag_effectiveness(x.scaled_tag_quality))
register("kpi_lookup", 6)(lambda x: reports.kpi_on(x.overview, DAY))
register("top_campaigns_gmv", 6)(lambda x: reports.top_campaigns(x.ranking, DAY, by="gmv"))
register("top_campaigns_roi", 6)(lambda x: reports.top_campaigns(x.ranking, DAY, by="roi"))
register("top_advertisers_gmv", 6)(
    lambda x: reports.top_advertisers(reports.advertiser_dashboard(x.advertiser_daily, DAY), DAY)
)


@register("tag_report", 6)
def _tag_report(x: Layers) -> DataFrame:
    snapshot = tags.user_tag_snapshot(x.user_daily, DAY, SCALED)
    return reports.tags_by_coverage(reports.tag_effectiveness(tags.tag_quality_daily(snapshot, DAY)), DAY)


# ---------------------------------------------------------------- skew

register("skew_simple")(lambda x: skew.impression_counts(x.events))
register("skew_totals")(lambda x: skew.campaign_totals(x.events))
register("skew_plain")(lambda x: skew.campaign_totals_by_rows(x.events))
register("skew_salted")(lambda x: skew.campaign_totals_salted(x.events, x.hot, distributed=True))
register("skew_salted_combined")(lambda x: skew.campaign_totals_salted(x.events, x.hot))
register("partition_balance")(lambda x: skew.partition_balance(skew.place_rows(x.events, PLACES)))
register("hot_keys")(lambda x: skew.hot_keys(x.events, min_share=HOT_SHARE))
register("rekey_skewed")(lambda x: x.skewed.select("event_id", "event_time", "campaign_id"))
register("rekey_uniform")(
    lambda x: skew.rekey_uniform(x.events, x.sequence, SKEW_KEYS).select("event_id", "event_time", "campaign_id")
)

# ---------------------------------------------------------------- sessions and profiles

register("sessionize")(
    lambda x: sessions.sessionize(x.events).select("dt", "user_id", "event_id", "event_time", "session_id")
)
register("user_device_pref")(lambda x: profile.user_device_preference(x.events))
register("dataset_summary")(lambda x: profile.dataset_summary(x.events, x.conversions, "cmp_0"))
register("product_distribution")(lambda x: profile.product_distribution(x.ads))

# ---------------------------------------------------------------- quality

@register("dq_report")
def _dq_report(x: Layers) -> DataFrame:
    """The gate over all layers. What several checks build on is stored once and read back."""
    folder = scratch_dir(x.spark, "gate")

    def stored(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder}/{name}"
        sinks.write_result(df, path)
        return tables.read_parquet(x.spark, path)

    impressions, clicks = stored("impressions", x.impressions), stored("clicks", x.clicks)
    converted = stored("conversions", x.converted)
    seen = metrics.traffic(impressions, clicks)
    campaigns = stored("campaigns", metrics.campaign_daily(seen, converted, x.day_cost))
    advertisers = stored("advertisers", metrics.advertiser_daily(seen, converted, x.day_cost))
    users = stored("users", metrics.user_daily(seen, converted))
    tag_quality = tags.tag_quality_daily(tags.user_tag_snapshot(users, thresholds=SCALED))
    return quality.dq_report(
        {
            "ods.ad_event_log": x.raw("events"),
            "ods.conversion_log": x.raw("conversions"),
            "ods.ad_cost": x.raw("cost"),
            "dwd.ad_impression_detail": impressions,
            "dwd.ad_click_detail": clicks,
            "dwd.ad_conversion_detail": converted,
            "dws.campaign_daily": campaigns,
            "dws.advertiser_daily": advertisers,
            "dws.user_daily": users,
            "dws.tag_quality_daily": tag_quality,
            "ads.kpi_overview_daily": reports.kpi_overview(campaigns, users),
            "ads.campaign_ranking_daily": reports.campaign_ranking(campaigns),
            "ads.advertiser_dashboard_daily": reports.advertiser_dashboard(advertisers),
            "ads.tag_effectiveness_daily": reports.tag_effectiveness(tag_quality),
        }
    )


register("dq_nulls")(
    lambda x: quality.null_counts(x.events, [*quality.REQUIRED_EVENT_COLUMNS, "session_id", "is_valid"])
)
register("dq_duplicates")(lambda x: quality.duplicate_groups(x.events, ["dt", "event_id"]))
register("dq_pk_rate")(lambda x: quality.key_unique_rate(x.events, ["dt", "event_id"]))
register("dq_filter_effect")(lambda x: quality.filter_effect(x.events))
register("dq_missing_rate")(lambda x: quality.missing_rate(x.impressions))
register("dq_logic")(lambda x: quality.logic_violations(x.campaign_daily))
register("dq_metric_sanity")(lambda x: quality.metric_sanity(x.campaign_daily))
