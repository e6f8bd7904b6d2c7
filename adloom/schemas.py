"""Fixed schemas of every table, by layer. DDL and CSV reading are both derived from these declarations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    layer: str
    name: str
    columns: str  # DDL of the non-partition columns, in table order
    partitioned: bool = True
    folder: str | None = None  # path below the warehouse root, if not <layer>/<name>

    @property
    def full_name(self) -> str:
        return f"{self.layer}.{self.name}"

    @property
    def path(self) -> str:
        return self.folder or f"{self.layer}/{self.layer}_{self.name}"

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)

    @property
    def names(self) -> list[str]:
        return [column.split()[0] for column in self.columns.split(", ")]


_EVENT_DETAIL = (
    "event_id string, event_time timestamp, user_id string, session_id string, ad_id string, campaign_id string, "
    "creative_id string, advertiser_id string, ad_type string, landing_type string, product_id string, site_id string, "
    "page_id string, ad_slot_id string, slot_type string, app string, position string, price_factor double, "
    "device string, user_agent string, ip string, event_type string"
)
_RATES = "ctr double, cvr double, rpm double, roi double"
_TRAFFIC = "impressions bigint, clicks bigint, conversions bigint"
_USER = "user_id string, gender string, age int, region string, device_type string, register_dt date"
_AD = (
    "ad_id string, campaign_id string, advertiser_id string, ad_type string, landing_type string, product_id string, "
    "start_dt date, end_dt date"
)
_SLOT = "ad_slot_id string, slot_type string, app string, position string, price_factor double"

# Table names, columns and types of the published warehouse layout.
TABLES = {
    t.full_name: t
    for t in (
        Table(
            "ods",
            "ad_event_log",
            "event_id string, event_time timestamp, user_id string, ad_id string, campaign_id string, "
            "creative_id string, site_id string, event_type string, device string, session_id string, "
            "ad_slot_id string, page_id string, is_valid int, ip string, user_agent string",
            folder="ods/ad_event_log",
        ),
        Table(
            "ods",
            "conversion_log",
            "conv_id string, conv_time timestamp, user_id string, ad_id string, campaign_id string, order_id string, "
            "gmv_amount double",
            folder="ods/conversion_log",
        ),
        Table("ods", "ad_cost", "campaign_id string, cost double", folder="ods/ad_cost"),
        Table("ods", "user_profile", _USER, partitioned=False, folder="ods/user_profile"),
        Table("ods", "ad_meta", _AD, partitioned=False, folder="ods/ad_meta"),
        Table("ods", "ad_slot", _SLOT, partitioned=False, folder="ods/ad_slot"),
        Table("dwd", "dim_user", _USER, folder="dwd/dim/dwd_dim_user"),
        Table("dwd", "dim_ad", _AD, folder="dwd/dim/dwd_dim_ad"),
        Table("dwd", "dim_ad_slot", _SLOT, folder="dwd/dim/dwd_dim_ad_slot"),
        Table("dwd", "ad_impression_detail", _EVENT_DETAIL),
        Table("dwd", "ad_click_detail", _EVENT_DETAIL),
        Table(
            "dwd",
            "ad_conversion_detail",
            "conv_id string, conv_time timestamp, user_id string, ad_id string, campaign_id string, "
            "advertiser_id string, product_id string, order_id string, gmv_amount double",
        ),
        Table("dwd", "campaign_day_cost", "campaign_id string, cost double"),
        Table("dws", "campaign_daily", f"campaign_id string, {_TRAFFIC}, gmv_amount double, cost double, {_RATES}"),
        Table("dws", "advertiser_daily", f"advertiser_id string, {_TRAFFIC}, gmv_amount double, cost double, {_RATES}"),
        Table(
            "dws",
            "user_daily",
            "user_id string, imp_cnt bigint, clk_cnt bigint, conv_cnt bigint, gmv_amount double, "
            "active_campaign_cnt bigint, last_event_time timestamp, ctr double, cvr double",
        ),
        Table(
            "dws",
            "user_tag_snapshot",
            "user_id string, tags array<string>, tag_cnt int, feature_7d_impressions bigint, feature_7d_clicks bigint, "
            "feature_7d_conversions bigint, feature_7d_gmv double, feature_7d_ctr double, feature_7d_cvr double, "
            "feature_day_impressions bigint, feature_day_clicks bigint, feature_day_conversions bigint, "
            "feature_day_gmv double, last_event_time timestamp",
        ),
        Table(
            "dws",
            "tag_quality_daily",
            "tag_name string, tagged_user_cnt bigint, total_user_cnt bigint, coverage_rate double, "
            "avg_ctr_tagged double, avg_cvr_tagged double, avg_gmv_tagged double",
        ),
        Table(
            "dws",
            "tag_dict",
            "tag_id string, tag_name string, tag_type string, rule_desc string, update_freq string, "
            "create_time timestamp",
            partitioned=False,
        ),
        Table(
            "ads",
            "kpi_overview_daily",
            f"{_TRAFFIC}, gmv double, cost double, ctr double, cvr double, rpm double, arpu double, "
            "active_users bigint, roi double",
        ),
        Table(
            "ads",
            "campaign_ranking_daily",
            f"campaign_id string, {_TRAFFIC}, gmv double, cost double, {_RATES}, rank_by_gmv int, rank_by_roi int",
        ),
        Table(
            "ads",
            "advertiser_dashboard_daily",
            f"advertiser_id string, {_TRAFFIC}, gmv double, cost double, ctr double, cvr double, roi double, "
            "revenue_growth_rate double, retention_flag int",
        ),
        Table(
            "ads",
            "tag_effectiveness_daily",
            "tag_name string, coverage_rate double, tagged_user_cnt bigint, avg_ctr_tagged double, "
            "avg_cvr_tagged double, avg_gmv_tagged double",
        ),
    )
}

# Raw CSV layouts. Text is read as text and typed afterwards, so that a bad value costs one NULL only.
CSV_SCHEMAS = {
    "ad_event_log": "event_id string, event_time string, dt string, user_id string, ad_id string, campaign_id string, "
    "creative_id string, site_id string, event_type string, device string, session_id string, ad_slot_id string, "
    "page_id string, is_valid int, ip string, user_agent string",
    "conversion_log": "conv_id string, conv_time string, dt string, user_id string, ad_id string, campaign_id string, "
    "order_id string, gmv_amount string",
    "ad_cost": "dt string, campaign_id string, cost string",
    "user_profile": "user_id string, gender string, age string, region string, device_type string, register_dt string",
    "ad_meta": "ad_id string, campaign_id string, advertiser_id string, ad_type string, landing_type string, "
    "product_id string, start_dt string, end_dt string",
    "ad_slot": "ad_slot_id string, slot_type string, app string, position string, price_factor string",
}
