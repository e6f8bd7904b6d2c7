"""Data-quality reports: each check is a count of violating rows, computed with as few passes as possible."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.parsing import is_time_type
from adloom.functions.ratios import safe_ratio

# Fixed value: event columns that must be filled.
REQUIRED_EVENT_COLUMNS = ("dt", "event_id", "campaign_id", "ad_id", "creative_id", "event_type")


@dataclass(frozen=True)
class TableChecks:
    """What must hold for one table. A check on a column that the table lacks fails."""

    layer: str
    table: str
    not_empty: bool = False
    time_columns: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    non_negative: tuple[str, ...] = ()
    rates: tuple[str, ...] = ()  # within [0, 1]; NULL passes
    unique_key: tuple[str, ...] = ()
    at_most: tuple[tuple[str, str], ...] = field(default=())  # (smaller, larger) column pairs
    finite: tuple[str, ...] = ()


# The gate over all layers.
GATE = (
    TableChecks(
        "ods", "ad_event_log", not_empty=True, time_columns=("event_time",), required=REQUIRED_EVENT_COLUMNS
    ),
    TableChecks("ods", "conversion_log", time_columns=("conv_time",)),
    TableChecks("ods", "ad_cost", not_empty=True, non_negative=("cost",)),
    TableChecks("dwd", "ad_impression_detail", time_columns=("event_time",), unique_key=("dt", "event_id")),
    TableChecks("dwd", "ad_click_detail", time_columns=("event_time",), unique_key=("dt", "event_id")),
    TableChecks("dwd", "ad_conversion_detail", time_columns=("conv_time",), unique_key=("dt", "conv_id")),
    TableChecks(
        "dws",
        "campaign_daily",
        not_empty=True,
        non_negative=("impressions", "clicks", "conversions", "gmv_amount", "cost", "roi"),
        rates=("ctr", "cvr"),
    ),
    TableChecks("dws", "advertiser_daily", rates=("ctr", "cvr")),
    TableChecks(
        "dws",
        "user_daily",
        not_empty=True,
        non_negative=("imp_cnt", "clk_cnt", "conv_cnt", "gmv_amount"),
        rates=("ctr", "cvr"),
    ),
    TableChecks(
        "dws", "tag_quality_daily", rates=("coverage_rate",), at_most=(("tagged_user_cnt", "total_user_cnt"),)
    ),
    TableChecks(
        "ads",
        "kpi_overview_daily",
        not_empty=True,
        non_negative=("impressions", "clicks", "conversions", "gmv", "cost", "active_users"),
        rates=("ctr", "cvr"),
    ),
    TableChecks("ads", "campaign_ranking_daily", rates=("ctr", "cvr")),
    TableChecks("ads", "advertiser_dashboard_daily", finite=("revenue_growth_rate",)),
    TableChecks("ads", "tag_effectiveness_daily", rates=("coverage_rate",)),
)


def _to_rows(df: DataFrame, values: Mapping[str, Column], keys: Sequence[str], name: str, value: str) -> DataFrame:
    """One aggregated row with many values -> one row per value."""
    entries = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()])
    return df.select(*keys, F.explode(entries).alias("e")).select(
        *keys, F.col("e.name").alias(name), F.col("e.value").alias(value)
    )


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_cnt")).where(F.col("row_cnt") > 1)


def _row_checks(df: DataFrame, checks: TableChecks) -> dict[str, Column]:
    """Violation counters that need a look at each row on its own."""

    c = F.col
    found: dict[str, Column] = {}
    named = [*checks.time_columns, *checks.required, *checks.non_negative, *checks.rates, *checks.finite]
    wanted = dict.fromkeys([*named, *(n for pair in checks.at_most for n in pair), *checks.unique_key])
    absent = [n for n in wanted if n not in df.columns]
    for n in absent:
        found[f"{n} is a column"] = F.lit(1).cast("bigint")

    def present(*names: str) -> bool:
        return not set(names) & set(absent)

    if checks.not_empty:
        found["not_empty"] = (F.count(F.lit(1)) == 0).cast("bigint")
    for n in filter(present, checks.time_columns):
        found[f"{n} is a timestamp"] = F.lit(0 if is_time_type(df, n) else 1).cast("bigint")
    for n in filter(present, checks.required):
        found[f"{n} not null"] = F.count_if(c(n).isNull())
    for n in filter(present, checks.non_negative):
        found[f"{n} >= 0"] = F.count_if(c(n) < 0)
    for n in filter(present, checks.rates):
        found[f"{n} in [0,1]"] = F.count_if(~c(n).between(0.0, 1.0))
    for low, high in checks.at_most:
        if present(low, high):
            found[f"{low} <= {high}"] = F.count_if(c(low) > c(high))
    for n in filter(present, checks.finite):
        found[f"{n} is finite"] = F.count_if(c(n).isin(float("inf"), float("-inf")))
    return found


def check_table(df: DataFrame, checks: TableChecks) -> DataFrame:
    """``(layer, table_name, check_name, bad_rows, passed)`` of one table.

    All row checks share one aggregate; key uniqueness adds a second one, grouped by the key and combined map-side.
    """
    parts = []
    counters = _row_checks(df, checks)
    if counters:
        slots = {f"c{i}": name for i, name in enumerate(counters)}
        counted = df.agg(*[v.alias(s) for s, v in zip(slots, counters.values())])
        values = {name: F.coalesce(F.col(s), F.lit(0)).cast("bigint") for s, name in slots.items()}
        parts.append(_to_rows(counted, values, [], "check_name", "bad_rows"))
    if checks.unique_key and set(checks.unique_key) <= set(df.columns):
        name = f"unique ({', '.join(checks.unique_key)})"
        groups = duplicate_groups(df, checks.unique_key).agg(F.count(F.lit(1)).alias("bad_rows"))
        parts.append(groups.select(F.lit(name).alias("check_name"), "bad_rows"))
    return reduce(DataFrame.unionByName, parts).select(
        F.lit(checks.layer).alias("layer"),
        F.lit(checks.table).alias("table_name"),
        "check_name",
        "bad_rows",
        (F.col("bad_rows") == 0).alias("passed"),
    )


def dq_report(tables: Mapping[str, DataFrame], gate: Sequence[TableChecks] = GATE) -> DataFrame:
    """The checks of all tables of the gate, keyed ``<layer>.<table>``, as one report; a table not given is an error."""
    lacking = [name for t in gate if (name := f"{t.layer}.{t.table}") not in tables]
    if lacking:
        raise ValueError(f"the gate checks tables that are not given: {', '.join(lacking)}")
    return reduce(DataFrame.unionByName, [check_table(tables[f"{t.layer}.{t.table}"], t) for t in gate])


class QualityGateError(RuntimeError):
    """At least one check found violating rows."""


def verdict(report: DataFrame) -> DataFrame:
    """One row: whether every check passed, how many failed, and a line for each of these. A check without outcome is neither."""
    line = F.concat("layer", F.lit("."), "table_name", F.lit(": "), "check_name", F.lit(": "), F.col("bad_rows").cast("string"), F.lit(" rows"))
    failed = report.where(~F.col("passed")).agg(
        F.count(F.lit(1)).alias("failed_checks"), F.sort_array(F.collect_list(line)).alias("lines")
    )
    return failed.select((F.col("failed_checks") == 0).alias("passed"), "failed_checks", F.array_join("lines", "\n").alias("messages"))


def enforce(report: DataFrame) -> None:
    """Run the whole report, then fail once with every violation. The report holds one row per check."""
    outcome = verdict(report).first()
    if not outcome.passed:
        raise QualityGateError(f"data quality gate failed\n{outcome.messages}")


def null_counts(df: DataFrame, columns: Sequence[str] = REQUIRED_EVENT_COLUMNS) -> DataFrame:
    """``(column_name, null_rows)`` for each of the columns; one that the table lacks is NULL in all rows."""
    null = {c: F.col(c).isNull() if c in df.columns else F.lit(True) for c in columns}
    counted = df.agg(*[F.count_if(n).alias(c) for c, n in null.items()])
    return _to_rows(counted, {c: F.col(c) for c in columns}, [], "column_name", "null_rows")


def key_unique_rate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and their ratio (1.0 for an empty table)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    distinct = F.count(F.lit(1))
    return per_key.agg(
        total.alias("total_rows"),
        distinct.alias("distinct_keys"),
        F.when(total == 0, F.lit(1.0)).otherwise(safe_ratio(distinct, total)).alias("unique_rate"),
    )


def filter_effect(events: DataFrame) -> DataFrame:
    """Per (dt, event type): rows before, rows left by the validity filter and deduplication, and the rate kept."""
    valid = F.coalesce(F.col("is_valid"), F.lit(1)) == 1
    per_event = events.groupBy("dt", "event_type", "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(valid).alias("kept")
    )
    before, after = F.sum("n"), F.count_if("kept")
    return per_event.groupBy("dt", "event_type").agg(
        before.alias("before_rows"), after.alias("after_rows"), safe_ratio(after, before).alias("kept_rate")
    )


def missing_rate(detail: DataFrame, columns: Sequence[str] = ("advertiser_id", "slot_type")) -> DataFrame:
    """Per dt: how many enriched rows found no dimension match, and how many advertisers were found.

    A missing rate of an empty table is 0.0.
    """
    names = [c for c in columns if c in detail.columns]
    measures = [F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in names]
    advertisers = [F.count_distinct("advertiser_id").alias("advertisers")] if "advertiser_id" in names else []
    counted = detail.groupBy("dt").agg(F.count(F.lit(1)).alias("total_rows"), *measures, *advertisers)
    rates = {f"{c}_missing_rate": safe_ratio(F.col(f"{c}_missing"), F.col("total_rows")) for c in names}
    return counted.withColumns(rates)


# Relations between metrics that do not hold, with the columns each needs.
LOGIC = {
    "clicks > impressions": ("clicks", "impressions"),
    "conversions > clicks": ("conversions", "clicks"),
    "cost < 0": ("cost",),
    "gmv_amount < 0": ("gmv_amount",),
}


def logic_violations(daily: DataFrame) -> DataFrame:
    """``(rule, bad_rows)`` of the relations between metrics, for the columns the table has."""
    usable = [name for name, needs in LOGIC.items() if set(needs) <= set(daily.columns)]
    slots = {f"c{i}": name for i, name in enumerate(usable)}
    counted = daily.agg(*[F.count_if(F.expr(name)).alias(s) for s, name in slots.items()])
    return _to_rows(counted, {name: F.col(s) for s, name in slots.items()}, [], "rule", "bad_rows")


def within(name: str, low: float | None, high: float | None) -> Column:
    """Whether a metric lies within its bounds; NULL does not."""
    ok = F.col(name).isNotNull()
    if low is not None:
        ok = ok & (F.col(name) >= low)
    return ok if high is None else ok & (F.col(name) <= high)


def metric_sanity(daily: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """``(metric, ok_rows, total_rows, ok_rate)``: rows whose metric lies within its bounds. NULL is not within."""
    wanted = bounds or {"ctr": (0.0, 1.0), "cvr": (0.0, 1.0), "roi": (0.0, None)}
    usable = {m: b for m, b in wanted.items() if m in daily.columns}

    counted = daily.agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.count_if(within(m, *b)).alias(m) for m, b in usable.items()]
    )
    rows = _to_rows(counted, {m: F.col(m) for m in usable}, ["total_rows"], "metric", "ok_rows")
    return rows.select("metric", "ok_rows", "total_rows", safe_ratio(F.col("ok_rows"), F.col("total_rows")).alias("ok_rate"))


# ---------------------------------------------------------------- measures taken while tables are built


@dataclass(frozen=True)
class Measure:
    """What a step of the build counted on the rows it wrote. ``good`` tells which rows the count is of."""

    table: str
    measure: str
    matching_rows: int
    total_rows: int
    good: bool = False


@dataclass(frozen=True)
class BuildChecks:
    """What is counted on a table as it is written: rows without a value, metrics within bounds, broken relations."""

    key: tuple[str, ...] = ()
    missing: tuple[str, ...] = ()
    bounds: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    logic: bool = False
    distinct: tuple[str, ...] = ()

    def conditions(self, columns: Sequence[str]) -> dict[str, tuple[Column, bool]]:
        """Condition and kind (good or bad rows) of each measure."""
        found = {f"{c} missing": (F.col(c).isNull(), False) for c in self.missing}
        found |= {f"{m} within bounds": (within(m, *b), True) for m, b in self.bounds.items()}
        if self.logic:
            found |= {name: (F.expr(name), False) for name, needs in LOGIC.items() if set(needs) <= set(columns)}
        return found


_RATES = {"ctr": (0.0, 1.0), "cvr": (0.0, 1.0)}

# The measures of every table the build writes.
BUILD_CHECKS = {
    "dwd.ad_impression_detail": BuildChecks(("dt", "event_id"), ("advertiser_id", "slot_type"), distinct=("advertiser_id",)),
    "dwd.ad_click_detail": BuildChecks(("dt", "event_id"), ("advertiser_id", "slot_type")),
    "dwd.ad_conversion_detail": BuildChecks(("dt", "conv_id"), ("advertiser_id",)),
    "dws.campaign_daily": BuildChecks(("dt", "campaign_id"), bounds={**_RATES, "roi": (0.0, None)}, logic=True),
    "dws.advertiser_daily": BuildChecks(("dt", "advertiser_id"), bounds={**_RATES, "roi": (0.0, None)}, logic=True),
    "dws.user_daily": BuildChecks(("dt", "user_id"), bounds={**_RATES, "gmv_amount": (0.0, None)}),
    "dws.tag_quality_daily": BuildChecks(("dt", "tag_name"), bounds={"coverage_rate": (0.0, 1.0)}),
    "ads.kpi_overview_daily": BuildChecks(("dt",), bounds={**_RATES, "roi": (0.0, None)}),
    "ads.campaign_ranking_daily": BuildChecks(("dt", "campaign_id"), bounds=_RATES),
    "ads.advertiser_dashboard_daily": BuildChecks(("dt", "advertiser_id")),
    "ads.tag_effectiveness_daily": BuildChecks(("dt", "tag_name"), bounds={"coverage_rate": (0.0, 1.0)}),
}


def distinct_rows(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """``(name, total_rows, distinct_keys)`` of each (table, key columns), all in one pass; only the keys are read.

    Rows of equal keys are combined before the exchange, so a frequent key costs one row per task.
    """
    keyed = [
        df.select(F.lit(name).alias("name"), F.to_json(F.array(*[F.col(k).cast("string") for k in keys])).alias("key"))
        for name, (df, keys) in tables.items()
    ]
    per_key = reduce(DataFrame.unionByName, keyed).groupBy("name", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("name").agg(F.sum("n").alias("total_rows"), F.count(F.lit(1)).alias("distinct_keys"))


def measures_report(spark: SparkSession, measures: Sequence[Measure]) -> DataFrame:
    """``(layer, table_name, measure, matching_rows, total_rows, rate)``; of no rows the rate is 1.0 for good ones, else 0.0."""
    rows = [(*m.table.split(".", 1), m.measure, m.matching_rows, m.total_rows, m.good) for m in measures]
    df = spark.createDataFrame(rows, "layer string, table_name string, measure string, matching_rows bigint, total_rows bigint, good boolean")
    rate = F.when((F.col("total_rows") == 0) & F.col("good"), F.lit(1.0)).otherwise(safe_ratio(F.col("matching_rows"), F.col("total_rows")))
    return df.withColumn("rate", rate).drop("good")


def as_checks(spark: SparkSession, measures: Sequence[Measure]) -> DataFrame:
    """The measures as rows of a report, without outcome: they inform and do not fail a run."""
    rows = [(*m.table.split(".", 1), m.measure, m.total_rows - m.matching_rows if m.good else m.matching_rows, None) for m in measures]
    return spark.createDataFrame(rows, "layer string, table_name string, check_name string, bad_rows bigint, passed boolean")
