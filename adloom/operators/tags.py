"""Rule-based user tags over the current day and the seven days ending with it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.functions.ratios import ctr, cvr, money, safe_ratio, stable_round
from adloom.schemas import TABLES
from adloom.sources.tables import last_days


@dataclass(frozen=True)
class Thresholds:
    """Limits of the tag rules."""

    # The published rules.
    active_days: int = 3
    ctr: float = 0.04
    ctr_impressions: int = 50
    cvr: float = 0.06
    cvr_clicks: int = 10
    gmv: float = 300.0
    day_clicks: int = 3
    day_impressions: int = 20
    day_conversions: int = 1


@dataclass(frozen=True)
class TagRule:
    tag_id: str
    tag_name: str
    tag_type: str
    rule_desc: str
    holds: Callable[[Thresholds], Column]


def _c(name: str) -> Column:
    return F.col(name)


# Tag dictionary. The descriptions state the default thresholds.
TAG_RULES = (
    TagRule(
        "tag_0001",
        "high_active_7d",
        "behavior",
        "近7天活跃天数>=3（当天有曝光或点击计为活跃）",
        lambda t: _c("feature_7d_active_days") >= t.active_days,
    ),
    TagRule(
        "tag_0002",
        "high_ctr_7d",
        "behavior",
        "近7天 CTR>=0.04 且 impressions>=50",
        lambda t: (_c("feature_7d_ctr") >= t.ctr) & (_c("feature_7d_impressions") >= t.ctr_impressions),
    ),
    TagRule(
        "tag_0003",
        "high_cvr_7d",
        "behavior",
        "近7天 CVR>=0.06 且 clicks>=10",
        lambda t: (_c("feature_7d_cvr") >= t.cvr) & (_c("feature_7d_clicks") >= t.cvr_clicks),
    ),
    TagRule(
        "tag_0004",
        "high_value_7d",
        "value",
        "近7天 GMV>=300",
        lambda t: _c("feature_7d_gmv") >= t.gmv,
    ),
    TagRule(
        "tag_0005",
        "ad_clicker",
        "behavior",
        "当天 clicks>=3",
        lambda t: _c("feature_day_clicks") >= t.day_clicks,
    ),
    TagRule(
        "tag_0006",
        "ad_viewer",
        "behavior",
        "当天 impressions>=20",
        lambda t: _c("feature_day_impressions") >= t.day_impressions,
    ),
    TagRule(
        "tag_0007",
        "converter",
        "behavior",
        "当天 conversions>=1",
        lambda t: _c("feature_day_conversions") >= t.day_conversions,
    ),
    TagRule(
        "tag_0008",
        "bounce_user",
        "risk",
        "当天 impressions>0 且 clicks=0 且 conversions=0（只看不点不转）",
        lambda t: (_c("feature_day_impressions") > 0)
        & (_c("feature_day_clicks") == 0)
        & (_c("feature_day_conversions") == 0),
    ),
)
UPDATE_FREQ = "daily"

SNAPSHOT_COLUMNS = ["dt", *TABLES["dws.user_tag_snapshot"].names]

_SUMMED = [
    "feature_7d_impressions",
    "feature_7d_clicks",
    "feature_7d_conversions",
    "feature_7d_gmv",
    "feature_7d_active_days",
]
_DAY = {
    "feature_day_impressions": "imp_cnt",
    "feature_day_clicks": "clk_cnt",
    "feature_day_conversions": "conv_cnt",
    "feature_day_gmv": "gmv_amount",
}


def _summed() -> dict[str, Column]:
    """What is added up over the window. A day with an impression or a click is an active day."""
    active = (F.col("imp_cnt") > 0) | (F.col("clk_cnt") > 0)
    values = [F.col("imp_cnt"), F.col("clk_cnt"), F.col("conv_cnt"), F.coalesce(money(F.col("gmv_amount")), F.lit(0))]
    return dict(zip(_SUMMED, [*values, active.cast("int")]))


def tag_dictionary(spark: SparkSession, create_time: Column | None = None) -> DataFrame:
    columns = ["tag_id", "tag_name", "tag_type", "rule_desc", "update_freq"]
    rows = ", ".join(str((r.tag_id, r.tag_name, r.tag_type, r.rule_desc, UPDATE_FREQ)) for r in TAG_RULES)
    created = F.current_timestamp() if create_time is None else create_time
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(columns)})").withColumn("create_time", created)


def _with_7d_rates(features: DataFrame) -> DataFrame:
    """Rates of the summed counts. They are rounded, and the tag rules compare the rounded value."""
    return features.withColumns(
        {
            "feature_7d_ctr": ctr(F.col("feature_7d_clicks"), F.col("feature_7d_impressions")),
            "feature_7d_cvr": cvr(F.col("feature_7d_conversions"), F.col("feature_7d_clicks")),
            "feature_7d_gmv": F.col("feature_7d_gmv").cast("double"),
        }
    )


def user_features(user_daily: DataFrame, days: int = 7) -> DataFrame:
    """Day and rolling features of every (dt, user), all days in one pass.

    One exchange on the user; a window group holds one row per active day of a user.
    """
    numbered = user_daily.withColumn("_day", F.datediff(F.col("dt").cast("date"), F.lit("1970-01-01").cast("date")))
    recent = W.partitionBy("user_id").orderBy("_day").rangeBetween(1 - days, W.currentRow)
    rolling = {name: F.sum(value).over(recent) for name, value in _summed().items()}
    latest = {"last_event_time": F.max("last_event_time").over(recent)}
    day = {name: F.coalesce(F.col(c), F.lit(0)) for name, c in _DAY.items()}
    wide = numbered.withColumns({**rolling, **latest, **day})
    return _with_7d_rates(wide).select(
        "dt", "user_id", *_SUMMED, "feature_7d_ctr", "feature_7d_cvr", *_DAY, "last_event_time"
    )


def user_features_on(user_daily: DataFrame, dt: str, days: int = 7) -> DataFrame:
    """The features of the users active on ``dt`` only.

    Prunes the history to the days needed and uses one aggregation: the day's own row is picked out by a condition
    instead of a join of the day with its history. ``user_daily`` must hold the day itself as well as the days before.
    """
    today = F.col("dt") == dt
    day = [F.coalesce(F.sum(F.when(today, F.col(c))), F.lit(0)).alias(name) for name, c in _DAY.items()]
    grouped = (
        last_days(user_daily, dt, days)
        .groupBy("user_id")
        .agg(
            *[F.sum(value).alias(name) for name, value in _summed().items()],
            *day,
            F.max("last_event_time").alias("last_event_time"),
            F.max(today).alias("_active"),
        )
        .where("_active")
        .withColumn("dt", F.lit(dt))
    )
    return _with_7d_rates(grouped).select(
        "dt", "user_id", *_SUMMED, "feature_7d_ctr", "feature_7d_cvr", *_DAY, "last_event_time"
    )


def attach_tags(
    features: DataFrame, thresholds: Thresholds = Thresholds(), rules: Sequence[TagRule] = TAG_RULES
) -> DataFrame:
    """Snapshot rows: the names of the rules that hold, in dictionary order, beside the features."""
    names = [F.when(rule.holds(thresholds), F.lit(rule.tag_name)) for rule in rules]
    tagged = features.withColumn("tags", F.array_compact(F.array(*names)))
    return tagged.withColumn("tag_cnt", F.size("tags")).select(*SNAPSHOT_COLUMNS)


def user_tag_snapshot(user_daily: DataFrame, dt: str | None = None, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Tags of the users active on ``dt``, or of every (dt, user) when no day is given."""
    features = user_features(user_daily) if dt is None else user_features_on(user_daily, dt)
    return attach_tags(features, thresholds)


def tag_rows(snapshot: DataFrame) -> DataFrame:
    """One row per (dt, user, tag); a user without tags keeps one row with a NULL tag."""
    return snapshot.select(
        "dt", "user_id", "feature_7d_ctr", "feature_7d_cvr", "feature_7d_gmv", F.explode_outer("tags").alias("tag_name")
    )


def tag_quality_daily(snapshot: DataFrame, dt: str | None = None, rules: Sequence[TagRule] = TAG_RULES) -> DataFrame:
    """Coverage and average rates of every dictionary tag, zero-filled where nobody carries it.

    ``snapshot`` holds one row per (dt, user), so users are counted without a distinct. All tags are aggregated side by
    side in one pass and then turned into rows: no exploded copy of the snapshot is shuffled, and a tag carried by most
    users is no heavier than any other. With ``dt`` the result has all tags even if the snapshot is empty.
    """
    per_tag = []
    for i, rule in enumerate(rules):
        carries = F.array_contains("tags", rule.tag_name)
        per_tag += [
            F.count_if(carries & F.col("user_id").isNotNull()).alias(f"n{i}"),
            *[F.avg(F.when(carries, F.col(f"feature_7d_{m}"))).alias(f"{m}{i}") for m in ("ctr", "cvr", "gmv")],
        ]
    total = F.count(F.lit(1)).alias("total_user_cnt")
    if dt is None:
        daily = snapshot.groupBy("dt").agg(total, *per_tag)
    else:
        daily = snapshot.where(F.col("dt") == dt).agg(total, *per_tag).withColumn("dt", F.lit(dt))

    entries = F.array(
        *[
            F.struct(
                F.lit(rule.tag_name).alias("tag_name"),
                F.col(f"n{i}").alias("tagged"),
                *[F.coalesce(F.col(f"{m}{i}"), F.lit(0.0)).alias(m) for m in ("ctr", "cvr", "gmv")],
            )
            for i, rule in enumerate(rules)
        ]
    )
    return daily.select("dt", "total_user_cnt", F.explode(entries).alias("t")).select(
        "dt",
        "t.tag_name",
        F.col("t.tagged").alias("tagged_user_cnt"),
        "total_user_cnt",
        safe_ratio(F.col("t.tagged"), F.col("total_user_cnt")).alias("coverage_rate"),
        stable_round(F.col("t.ctr")).alias("avg_ctr_tagged"),
        stable_round(F.col("t.cvr")).alias("avg_cvr_tagged"),
        F.col("t.gmv").alias("avg_gmv_tagged"),
    )
