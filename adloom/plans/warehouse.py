"""The daily build: raw CSV to landed tables, detail tables, daily metrics and tags, reports, quality gate.

Tables live below one root directory, or in the catalog once declared. Every step reads what the step before has
stored, so a lost executor costs a task of the current step only, and any step can be run again for any range of days.
A range is handled in one job, not day by day: the rolling tags of many days come from one window.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.operators import clean, enrich, metrics, quality, reports, tags
from adloom.schemas import TABLES
from adloom.sources import landing, sinks, tables

FACTS = ("ad_event_log", "conversion_log", "ad_cost")
DIMENSIONS = ("user_profile", "ad_meta", "ad_slot")

# An inclusive range of days, or None for all days there are.
Days = tuple[str, str] | None


@dataclass(frozen=True)
class Warehouse:
    """Tables below ``root``. ``measures`` gathers what the steps of a build count on the rows they write."""

    spark: SparkSession
    root: str
    measures: list[quality.Measure] = field(default_factory=list, compare=False)

    def path(self, name: str) -> str:
        return f"{self.root}/{TABLES[name].path}"

    def read(self, name: str, days: Days = None) -> DataFrame:
        df = tables.read_table(self.spark, name, self.path(name))
        return df if days is None else df.where(F.col("dt").between(*days))

    def store(
        self, name: str, df: DataFrame, days: Days = None, losses: Mapping[str, Column] | None = None, by_size: bool = True
    ) -> int:
        """Store ``df``; a day of the range ``days`` that it has no rows of becomes empty. Returns the rows written.

        The measures of the table (see ``quality.BUILD_CHECKS``) and ``losses`` are counted by the tasks that write.
        """
        table = TABLES[name]
        known = quality.BUILD_CHECKS.get(name, quality.BuildChecks()).conditions(df.columns)
        wanted = {**{label: c for label, (c, _) in known.items()}, **(losses or {})}
        if table.partitioned:
            listed = tables.days_between(*days) if days else ()
            counted = sinks.store_days(df, table, self.path(name), listed, wanted, by_size)
        else:
            counted = sinks.write_whole(df, table, self.path(name), wanted)
        total, held = counted.counts()
        good = {label for label, (_, is_good) in known.items() if is_good}
        self.measures.extend(quality.Measure(name, label, n, total, label in good) for label, n in held.items())
        return total

    def days(self, name: str, days: Days = None) -> list[str]:
        """The days a table has, within the range; from metadata alone."""
        listed = tables.partition_days(self.spark, name, self.path(name))
        return [d for d in listed if days is None or days[0] <= d <= days[1]]

    def declare(self) -> None:
        """Create the catalog tables over the directories, and register the days already there."""
        for name, table in TABLES.items():
            sinks.declare_table(self.spark, table, self.path(name))
            if table.partitioned and tables.path_exists(self.spark, self.path(name)):
                sinks.register_partitions(self.spark, name)


def land_all(warehouse: Warehouse, input_dir: str, days: Days = None) -> None:
    """Raw CSVs ``ods_<source>.csv`` below ``input_dir`` to typed Parquet; facts by day, only those of the range."""
    for source in (*FACTS, *DIMENSIONS):
        landed, losses = landing.land_counted(warehouse.spark, source, f"{input_dir}/ods_{source}.csv")
        if days and source in FACTS:
            landed = landed.where(F.col("dt").between(*days))
        warehouse.store(f"ods.{source}", landed, days, losses)


def build_details(warehouse: Warehouse, days: Days = None) -> None:
    """Dimension snapshots, and clean, unique, enriched detail tables."""
    w = warehouse
    events = clean.standard_events(w.read("ods.ad_event_log", days))
    conversions = clean.standard_conversions(w.read("ods.conversion_log", days))
    cost = clean.standard_cost(w.read("ods.ad_cost", days))
    users = clean.user_dimension(w.read("ods.user_profile"))
    ads = clean.ad_dimension(w.read("ods.ad_meta"))
    slots = clean.slot_dimension(w.read("ods.ad_slot"))

    listed = w.days("ods.ad_event_log", days)
    for name, dimension in (("dwd.dim_user", users), ("dwd.dim_ad", ads), ("dwd.dim_ad_slot", slots)):
        w.store(name, clean.daily_snapshot(dimension, listed), by_size=False)

    before = {r.event_type: r.n for r in events.where(F.col("event_type").isin(*enrich.EVENT_TYPES)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    for kind, detail in (("impression", enrich.impression_detail), ("click", enrich.click_detail)):
        name = f"dwd.ad_{kind}_detail"
        kept = w.store(name, detail(events, ads, slots), days)
        w.measures.append(quality.Measure(name, "kept by filter and deduplication", kept, before.get(kind, 0), True))
    w.store("dwd.ad_conversion_detail", enrich.conversion_detail(conversions, ads), days)
    w.store("dwd.campaign_day_cost", clean.campaign_day_cost(cost), days)


def build_daily(warehouse: Warehouse, days: Days = None, thresholds: tags.Thresholds = tags.Thresholds()) -> None:
    """Daily metrics, then the user tags over the stored history and their quality."""
    w = warehouse
    seen = metrics.traffic(w.read("dwd.ad_impression_detail", days), w.read("dwd.ad_click_detail", days))
    conversions = w.read("dwd.ad_conversion_detail", days)
    cost = w.read("dwd.campaign_day_cost", days)
    w.store("dws.campaign_daily", metrics.campaign_daily(seen, conversions, cost), days)
    w.store("dws.advertiser_daily", metrics.advertiser_daily(seen, conversions, cost), days)
    w.store("dws.user_daily", metrics.user_daily(seen, conversions), days)

    w.store("dws.tag_dict", tags.tag_dictionary(w.spark))
    w.store("dws.user_tag_snapshot", _snapshot(w, days, thresholds), days)
    w.store("dws.tag_quality_daily", tags.tag_quality_daily(w.read("dws.user_tag_snapshot", days)), days)


def _snapshot(w: Warehouse, days: Days, thresholds: tags.Thresholds) -> DataFrame:
    if days is None:
        return tags.user_tag_snapshot(w.read("dws.user_daily"), thresholds=thresholds)
    first, last = days
    if first == last:
        return tags.user_tag_snapshot(w.read("dws.user_daily"), last, thresholds)
    history = w.read("dws.user_daily", (tables.day_window(first)[0], last))
    return tags.user_tag_snapshot(history, thresholds=thresholds).where(F.col("dt").between(first, last))


def build_reports(warehouse: Warehouse, days: Days = None) -> None:
    w = warehouse
    campaigns = w.read("dws.campaign_daily", days)
    w.store("ads.kpi_overview_daily", reports.kpi_overview(campaigns, w.read("dws.user_daily", days)), days)
    w.store("ads.campaign_ranking_daily", reports.campaign_ranking(campaigns), days)
    if days is None:
        dashboard = reports.advertiser_dashboard(w.read("dws.advertiser_daily"))
    else:
        history = w.read("dws.advertiser_daily", (tables.day_window(days[0], 2)[0], days[1]))
        dashboard = reports.advertiser_dashboard(history).where(F.col("dt").between(*days))
    w.store("ads.advertiser_dashboard_daily", dashboard, days)
    w.store("ads.tag_effectiveness_daily", reports.tag_effectiveness(w.read("dws.tag_quality_daily", days)), days)


def check(warehouse: Warehouse, days: Days = None) -> DataFrame:
    """The quality report over all layers; hand it to ``quality.enforce`` to stop a run on violations."""
    names = [f"{t.layer}.{t.table}" for t in quality.GATE]
    return quality.dq_report({name: warehouse.read(name, days) for name in names})


def measure_keys(warehouse: Warehouse, days: Days = None) -> None:
    """Adds how many rows of every built table have a key of their own, and the distinct values asked for, in one pass."""
    w = warehouse
    wanted = {}
    for name, checks in quality.BUILD_CHECKS.items():
        df = w.read(name, days)
        wanted[name, f"distinct ({', '.join(checks.key)})"] = (df, checks.key)
        wanted |= {(name, f"distinct {c}"): (df, (c,)) for c in checks.distinct}
    numbered = {str(i): pair for i, pair in enumerate(wanted.values())}
    found = {r["name"]: r for r in quality.distinct_rows(numbered).collect()}
    for i, (name, label) in enumerate(wanted):
        row = found.get(str(i))
        w.measures.append(quality.Measure(name, label, row.distinct_keys if row else 0, row.total_rows if row else 0, True))


def build_all(warehouse: Warehouse, input_dir: str, days: Days = None, enforce: bool = True) -> DataFrame:
    """All steps in order. Returns the quality report; with ``enforce`` a violation raises after everything is stored.

    The report holds the checks of the gate and, without outcome, what the steps counted on the rows they wrote: values and lines
    lost on landing, missing attributes, metrics within bounds, rows kept and distinct keys.
    """
    warehouse.measures.clear()
    land_all(warehouse, input_dir, days)
    build_details(warehouse, days)
    build_daily(warehouse, days)
    build_reports(warehouse, days)
    measure_keys(warehouse, days)
    report = check(warehouse, days).unionByName(quality.as_checks(warehouse.spark, warehouse.measures))
    if enforce:
        quality.enforce(report)
    return report
