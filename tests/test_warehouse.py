"""The daily build end to end, from CSV files."""

import datetime as d
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from adloom.operators import quality, tags
from adloom.plans import warehouse as wh
from adloom.schemas import CSV_SCHEMAS, TABLES
from adloom.sources import sinks, tables

DAYS = [(d.date(2024, 2, 25) + d.timedelta(days=i)).isoformat() for i in range(9)]
DAILY = ["dws.campaign_daily", "dws.advertiser_daily", "dws.user_daily", "dws.user_tag_snapshot",
         "dws.tag_quality_daily", "ads.kpi_overview_daily", "ads.campaign_ranking_daily",
         "ads.advertiser_dashboard_daily", "ads.tag_effectiveness_daily"]


def write_csv(folder, source, records):
    names = [c.split()[0] for c in CSV_SCHEMAS[source].split(", ")]
    lines = [",".join(names)] + [",".join(str(r.get(n, "")) for n in names) for r in records]
    (folder / f"ods_{source}.csv").write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """Nine days of events with copies; conversions never exceed clicks, so that the gate can pass."""
    folder = tmp_path_factory.mktemp("raw")
    rng = random.Random(11)
    events, conversions, cost = [], [], []
    for dt in DAYS:
        for i in range(120):
            n = len(events)
            campaign = "cmp_hot" if i % 3 else f"cmp_{i % 7}"
            common = dict(dt=dt, user_id=f"u{rng.randrange(30)}", ad_id=f"ad_{i % 10}", campaign_id=campaign)
            time = f"{dt} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00"
            row = dict(event_id=f"e{n}", event_time=time, creative_id="c", site_id="s", device="ios",
                       ad_slot_id="slot_1", page_id="home", is_valid=int(i % 40 != 39), ip="10.0.0.1",
                       user_agent="ios_app", session_id="", **common)
            events.append(dict(row, event_type="impression"))
            if i % 10 == 0:
                events.append(dict(row, event_type="click", event_id=f"k{n}", is_valid=1))
            if i % 30 == 0:
                conversions.append(dict(conv_id=f"v{n}", conv_time=time, order_id=f"o{n}",
                                        gmv_amount=round(rng.uniform(1, 200), 2), **common))
        for campaign in ["cmp_hot", *[f"cmp_{j}" for j in range(7)]]:
            cost.append(dict(dt=dt, campaign_id=campaign, cost=round(rng.uniform(1, 50), 2)))
    events += [dict(e) for e in events[::9]]
    write_csv(folder, "ad_event_log", events)
    write_csv(folder, "conversion_log", conversions)
    write_csv(folder, "ad_cost", cost)
    write_csv(folder, "user_profile", [dict(user_id=f"u{i}", gender="F", age=20 + i, register_dt="2023-01-01") for i in range(30)])
    write_csv(folder, "ad_meta", [
        dict(ad_id=f"ad_{i}", campaign_id=c, advertiser_id=f"adv_{i % 3}", ad_type="video", landing_type="app",
             product_id="" if i % 2 else f"p{i}", start_dt="2024-01-01", end_dt="2024-12-31")
        for i in range(10) for c in ["cmp_hot", *[f"cmp_{j}" for j in range(7)]]
    ])
    write_csv(folder, "ad_slot", [dict(ad_slot_id="slot_1", slot_type="feed", app="main", position="top", price_factor="1.1")])
    return str(folder)


@pytest.fixture(scope="module")
def built(spark, raw, tmp_path_factory):
    w = wh.Warehouse(spark, str(tmp_path_factory.mktemp("all")))
    report = wh.build_all(w, raw, enforce=False)
    return w, report


def same(a, b, rows):
    columns = [c for c in a.columns]
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in a.dtypes]
    return rows(a.select(*rounded), *columns) == rows(b.select(*rounded), *columns)


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_gate_passes_on_sound_data(built):
    w, report = built
    bad = [(r.table_name, r.check_name, r.bad_rows) for r in report.where("not passed").collect()]
    # A user may click without an impression of the same day, so user rates can exceed one; nothing else may fail.
    assert all(table == "user_daily" and check.startswith(("ctr", "cvr")) for table, check, _ in bad)


def test_tables_have_declared_types(built):
    w, _ = built
    for name, table in TABLES.items():
        got = dict(w.read(name).dtypes)
        want = {f.name: f.dataType.simpleString() for f in table.schema.fields}
        if table.partitioned:
            want["dt"] = "string"
        assert got == want, name


def test_counts_agree_across_layers(built):
    w, _ = built
    imp = w.read("dwd.ad_impression_detail")
    assert imp.count() == imp.select("dt", "event_id").distinct().count()
    assert w.read("dws.campaign_daily").agg(F.sum("impressions")).first()[0] == imp.count()
    assert w.read("ads.kpi_overview_daily").agg(F.sum("impressions")).first()[0] == imp.count()
    cost = w.read("dwd.campaign_day_cost").agg(F.sum("cost")).first()[0]
    assert w.read("dws.advertiser_daily").agg(F.sum("cost")).first()[0] == pytest.approx(cost)
    assert w.read("dwd.dim_ad").count() == len(DAYS) * w.read("ods.ad_meta").count()


def test_day_by_day_equals_one_run(spark, raw, built, rows, tmp_path_factory):
    w = wh.Warehouse(spark, str(tmp_path_factory.mktemp("daily")))
    wh.land_all(w, raw)
    for dt in DAYS[:2]:
        day = (dt, dt)
        wh.build_details(w, day)
        wh.build_daily(w, day)
        wh.build_reports(w, day)
    rest = (DAYS[2], DAYS[-1])
    wh.build_details(w, rest)
    wh.build_daily(w, rest)
    wh.build_reports(w, rest)
    for name in DAILY:
        assert same(w.read(name), built[0].read(name), rows), name


def test_rerun_of_a_day_leaves_other_days_alone(built):
    w, _ = built
    root = w.path("dws.campaign_daily")
    before = files(root)
    wh.build_daily(w, (DAYS[4], DAYS[4]))
    after = files(root)
    kept = {f: t for f, t in before.items() if f"dt={DAYS[4]}" not in f}
    assert kept and {f: t for f, t in after.items() if f"dt={DAYS[4]}" not in f} == kept
    assert not {f for f in before if f"dt={DAYS[4]}" in f} & set(after)


def test_single_day_is_pruned(built, capsys):
    w, _ = built
    tables.one_day(w.read("dws.campaign_daily"), DAYS[0]).explain()
    plan = capsys.readouterr().out
    filters = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert DAYS[0] in filters


def test_catalog_tables(spark, built, rows):
    w, _ = built
    try:
        w.declare()
        w.declare()  # keeps what is there
        name = "dws.campaign_daily"
        table = TABLES[name]
        assert [r.dt for r in tables.table_days(spark, name).collect()] == DAYS
        before = tables.read_table(spark, name, "unused")
        assert before.columns == [*table.names, "dt"]
        other = rows(before.where(f"dt <> '{DAYS[0]}'"))

        doubled = before.where(f"dt = '{DAYS[0]}'").withColumn("cost", F.col("cost") * 2)
        want = rows(doubled)
        stored = spark.createDataFrame(doubled.collect(), doubled.schema)
        sinks.insert_day(stored, table, DAYS[0])
        assert rows(spark.table(name).where(f"dt = '{DAYS[0]}'")) == want
        assert rows(spark.table(name).where(f"dt <> '{DAYS[0]}'")) == other

        # By name, several days at once: only the days present are replaced, whatever the session default is.
        w.store(name, stored.withColumn("dt", F.lit("2024-05-01")))
        assert rows(spark.table(name).where(f"dt <> '{DAYS[0]}' and dt < '2024-05'")) == other
        assert spark.table(name).where("dt = '2024-05-01'").count() == len(want)

        sinks.insert_day(stored.where("false"), table, "2024-05-01")
        assert spark.table(name).where("dt = '2024-05-01'").isEmpty()
        spark.sql("ALTER TABLE dws.campaign_daily DROP PARTITION (dt = '2024-05-01')")

        found = tables.first_nonempty_source(
            spark,
            [("table", "dws.none"), ("path", w.root + "/none"), ("table", name), ("path", w.path(name))],
            DAYS[1],
        )
        assert rows(found) == rows(spark.table(name).where(f"dt = '{DAYS[1]}'"))
        w.store("dws.tag_dict", tags.tag_dictionary(spark))
        assert w.read("dws.tag_dict").count() == 8
    finally:
        for name in TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for db in ("ods", "dwd", "dws", "ads"):
            spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def test_build_into_declared_tables(spark, raw, built, rows, tmp_path):
    """Declared first, everything is written and read by name, also when a day is built again."""
    w = wh.Warehouse(spark, str(tmp_path / "declared"))
    try:
        w.declare()
        wh.build_all(w, raw, enforce=False)
        wh.build_daily(w, (DAYS[3], DAYS[3]))
        wh.build_reports(w, (DAYS[3], DAYS[3]))
        for name in DAILY:
            assert same(spark.table(name), built[0].read(name), rows), name
            assert [r.dt for r in tables.table_days(spark, name).collect()] == DAYS
    finally:
        for name in TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for db in ("ods", "dwd", "dws", "ads"):
            spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def test_enforced_gate_raises_after_storing(spark, raw, tmp_path):
    w = wh.Warehouse(spark, str(tmp_path))
    report = spark.createDataFrame([("ods", "t", "c", 3, False)], "layer string, table_name string, check_name string, bad_rows bigint, passed boolean")
    with pytest.raises(quality.QualityGateError, match="ods.t: c: 3 rows"):
        quality.enforce(report)
    with pytest.raises(FileNotFoundError):
        w.read("ods.ad_event_log")


def test_files_are_sized_not_fixed(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), F.lit("2024-01-01").alias("dt"))
    sinks.write_days(df, str(tmp_path / "t"))
    assert len(list((tmp_path / "t" / "dt=2024-01-01").glob("*.parquet"))) == 1


def test_rebuilding_a_day_without_rows_empties_it(spark, rows, tmp_path):
    table, path = TABLES["dwd.campaign_day_cost"], str(tmp_path / "cost")
    both = spark.createDataFrame([("2024-03-01", "c", 1.0), ("2024-03-02", "c", 2.0)], "dt string, campaign_id string, cost double")
    days = ["2024-03-01", "2024-03-02", "2024-03-03"]
    sinks.store_days(both, table, path, days)
    assert len(rows(spark.read.parquet(path), "campaign_id", "cost")) == 2
    sinks.store_days(both.where("dt = '2024-03-03'"), table, path, days[1:])
    assert rows(spark.read.parquet(path), "dt", "cost")[0][1] == 1.0
    assert spark.read.parquet(path).count() == 1


def test_snapshots_without_exchange(spark, tmp_path):
    """Days of a snapshot are written by the tasks that have the dimension; the session's settings stay as they were."""
    from adloom.operators import clean

    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    days = [f"2024-01-{i:02d}" for i in range(1, 31)]
    raw = spark.range(0, 500, numPartitions=3).selectExpr("concat('s', id) AS ad_slot_id")
    table = TABLES["dwd.dim_ad_slot"]
    slots = raw.select(*[F.col(f.name) if f.name == "ad_slot_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    snapshot = clean.daily_snapshot(slots, days)
    plan = sinks.Counted(snapshot, table, by_size=False).rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    counted = sinks.store_days(snapshot, table, str(tmp_path / "snapshot"), by_size=False)
    assert counted.counts()[0] == 15000 and spark.conf.get(key) == before
    held = spark.read.parquet(str(tmp_path / "snapshot")).groupBy(F.col("dt").cast("string")).agg(F.countDistinct("ad_slot_id").alias("n")).collect()
    assert len(held) == 30 and {r.n for r in held} == {500}
