"""Registered queries that write: landing from files, the catalog, replacing days and tables, and the measures of a build.

Each works in a folder of its own below the shared one. What it returns is read from the tables it has written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.functions.parsing import DAY_FORMAT
from adloom.operators import quality
from adloom.plans import warehouse as wh
from adloom.plans.queries import DAY, REGISTRY, SCALED, Layers, register, through_csv
from adloom.schemas import CSV_SCHEMAS, TABLES, Table
from adloom.session import scratch_dir
from adloom.sources import landing, sinks, tables

OTHER_DAY = "2024-01-29"
_BEFORE = set(REGISTRY)


def _every(column: str, remainder: int) -> str:
    return f"CAST({column} AS BIGINT) % 50 = {remainder}"


def _text(raw: DataFrame, source: str) -> DataFrame:
    """``raw`` in the layout of the CSV source, all text."""
    out = []
    for f in T.StructType.fromDDL(CSV_SCHEMAS[source]).fields:
        kind = raw.schema[f.name].dataType if f.name in raw.columns else None
        if kind is None:
            c = F.lit(None).cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            c = F.date_format(f.name, DAY_FORMAT)
        else:
            c = F.col(f.name).cast("string")
        out.append(c.alias(f.name))
    return raw.select(*out)


# Values and lines that cannot be read, planted by source: column, condition, text.
PLANTED = {
    "ad_event_log": (
        ("event_time", _every("event_id", 7), "yesterday"),
        ("is_valid", _every("event_id", 3), "yes"),
        ("user_agent", _every("event_id", 4), "one,field more"),
    ),
    "conversion_log": (("conv_time", _every("conv_id", 8), "2024-13-01 00:00:00"), ("gmv_amount", _every("conv_id", 9), "n/a")),
    "user_profile": (("age", _every("user_id", 5), "unknown"), ("age", _every("user_id", 6), " "), ("register_dt", _every("user_id", 7), "01.06.2023")),
    "ad_slot": (("price_factor", "ad_slot_id = '3'", "1,1"),),
}


def _files(x: Layers, source: str, raw: DataFrame) -> str:
    """CSV files with a header, in which some values and lines cannot be read; returns their folder.

    Nothing is quoted, so a comma inside a value makes a field too many.
    """
    path = scratch_dir(x.spark, f"csv_{source}")
    text = _text(raw, source)
    for column, when, wrong in PLANTED[source]:
        text = text.withColumn(column, F.when(F.expr(when), F.lit(wrong)).otherwise(F.col(column)))
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in text.columns]).alias(",".join(text.columns))
    text.select(line).write.option("header", True).option("sep", "\u0001").csv(path)
    return path


@register("csv_files")
def _csv_files(x: Layers) -> DataFrame:
    """The event log from files, with the lines that do not fit marked. The files are removed once they have landed."""
    path = _files(x, "ad_event_log", x.raw("events"))
    landed, losses = landing.land_counted(x.spark, "ad_event_log", path)
    kept = scratch_dir(x.spark, "landed_events")
    marked = landed.withColumn("malformed", losses["malformed line"])
    marked.select("event_id", "event_time", "dt", "user_id", "ad_id", "is_valid", "ip", "user_agent", "malformed").write.parquet(kept)
    sinks.remove(x.spark, path)
    return tables.read_parquet(x.spark, kept)


@register("dq_landing_losses")
def _landing_losses(x: Layers) -> DataFrame:
    """What landing lost, counted by the tasks that write the landed tables."""
    w = wh.Warehouse(x.spark, scratch_dir(x.spark, "landing"))
    for source, raw in (("ad_event_log", "events"), ("conversion_log", "conversions"), ("user_profile", "users"), ("ad_slot", "slots")):
        path = _files(x, source, x.raw(raw))
        landed, losses = landing.land_counted(x.spark, source, path)
        w.store(f"ods.{source}", landed, losses=losses)
        sinks.remove(x.spark, path)
    return quality.measures_report(x.spark, w.measures)


@register("dq_build_measures")
def _build_measures(x: Layers) -> DataFrame:
    """The whole build, from landed tables to reports, and everything its steps count on what they write."""
    w = wh.Warehouse(x.spark, scratch_dir(x.spark, "build"))
    for source, raw in (
        ("ad_event_log", "events"),
        ("conversion_log", "conversions"),
        ("ad_cost", "cost"),
        ("user_profile", "users"),
        ("ad_meta", "ads"),
        ("ad_slot", "slots"),
    ):
        w.store(f"ods.{source}", through_csv(x, x.raw(raw), source))
    wh.build_details(w)
    wh.build_daily(w, thresholds=SCALED)
    wh.build_reports(w)
    wh.measure_keys(w)
    return quality.measures_report(x.spark, w.measures)


def _declared(x: Layers, label: str, columns: str, partitioned: bool) -> tuple[Table, str]:
    """A new catalog table over an empty folder, in a database of its own."""
    location = scratch_dir(x.spark, label)
    layer = location.rsplit("/", 1)[-1].replace("-", "_")
    table = Table(layer, label, columns, partitioned)
    sinks.declare_table(x.spark, table, location)
    return table, location


COST = TABLES["dwd.campaign_day_cost"].columns


@register("catalog_read")
def _catalog_read(x: Layers) -> DataFrame:
    """Days written by path, declared as a table, registered, then read by name."""
    table, location = _declared(x, "cost_by_name", COST, True)
    sinks.write_days(sinks.conform(x.day_cost, table), location)
    sinks.register_partitions(x.spark, table.full_name)
    return tables.read_table(x.spark, table.full_name, "no such folder")


@register("insert_day")
def _insert_day(x: Layers) -> DataFrame:
    """One day of a catalog table inserted again with other values, and another emptied."""
    table, location = _declared(x, "cost_inserted", COST, True)
    sinks.store_days(x.day_cost, table, location)
    tripled = x.day_cost.withColumn("cost", F.col("cost") * 3)
    sinks.insert_day(tripled, table, DAY)
    sinks.insert_day(tripled.where("cost IS NULL"), table, OTHER_DAY)
    return tables.read_table(x.spark, table.full_name, location)


@register("replace_table")
def _replace_table(x: Layers) -> DataFrame:
    """A whole catalog table replaced while a query on it is open: that one still sees the rows from before."""
    table, location = _declared(x, "slots_replaced", TABLES["ods.ad_slot"].columns, False)
    sinks.write_whole(x.slots, table, location)
    open_query = x.spark.table(table.full_name).withColumn("version", F.lit("before"))
    sinks.write_whole(x.slots.where("app <> '0'").withColumn("price_factor", F.col("price_factor") + 1), table, location)
    return open_query.unionByName(x.spark.table(table.full_name).withColumn("version", F.lit("after")))


@register("file_sizing")
def _file_sizing(x: Layers) -> DataFrame:
    """Files, rows and bytes of each day of a written table; days of this size are one file each."""
    path = scratch_dir(x.spark, "sized")
    sinks.write_days(x.day_cost, path)
    sizes = tables.file_sizes(x.spark, path)
    return sizes.select("dt", "files", "row_cnt", (F.col("bytes") >= F.col("largest_file")).alias("has_bytes"))


@register("partition_days")
def _partition_days(x: Layers) -> DataFrame:
    """Days of a directory and of the catalog table declared over it, from metadata alone."""
    table, location = _declared(x, "cost_days", COST, True)
    sinks.write_days(sinks.conform(x.day_cost, table), location)
    by_path = tables.partition_days(x.spark, "no_such.table", location)
    sinks.register_partitions(x.spark, table.full_name)
    by_name = tables.partition_days(x.spark, table.full_name, location)
    rows = [("path", d) for d in by_path] + [("catalog", d) for d in by_name]
    return x.spark.createDataFrame(rows, "source string, dt string")


@register("first_nonempty_stored")
def _first_nonempty_stored(x: Layers) -> DataFrame:
    """The first source with rows for the day: after a missing table, a missing folder and a table without that day, a folder."""
    table, location = _declared(x, "cost_early", COST, True)
    sinks.store_days(x.day_cost.where(F.col("dt") < DAY), table, location)
    path = scratch_dir(x.spark, "cost_late")
    sinks.write_days(x.day_cost, path)
    sources = [("table", "no_such.table"), ("path", f"{path}/missing"), ("table", table.full_name), ("path", path)]
    return tables.first_nonempty_source(x.spark, sources, DAY).select("dt", "campaign_id", "cost")


@register("dq_verdict")
def _verdict(x: Layers) -> DataFrame:
    """The outcome of a report with planted violations: all failures are gathered before the run would stop."""
    daily = x.campaign_daily.withColumns(
        {
            "cost": F.when(F.col("campaign_id") == "cmp_3", -F.col("cost") - 1).otherwise(F.col("cost")),
            "ctr": F.when(F.col("campaign_id") == "cmp_4", F.lit(1.5)).otherwise(F.col("ctr")),
        }
    )
    gate = {f"{t.layer}.{t.table}": t for t in quality.GATE}
    reports = [
        quality.check_table(daily, gate["dws.campaign_daily"]),
        quality.check_table(x.events, quality.TableChecks("dwd", "ad_event_detail", unique_key=("dt", "event_id"))),
        quality.check_table(x.cost, gate["ods.ad_cost"]),
    ]
    return quality.verdict(reduce(DataFrame.unionByName, reports))


# The names of these queries: unlike the others, they run jobs while the plan is made.
WRITING = frozenset(REGISTRY) - _BEFORE
