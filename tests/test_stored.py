"""Landing with losses, counts taken on writing, swapping tables in, and metadata listings."""

import pytest
from pyspark.sql import functions as F

from adloom.operators import quality
from adloom.plans import warehouse as wh
from adloom.schemas import Table
from adloom.sources import landing, sinks, tables

LINES = """conv_id,conv_time,dt,user_id,ad_id,campaign_id,order_id,gmv_amount
c1,2024-01-01 00:00:01,2024-01-01,u,a,k,o,1.5
c2,soon,2024-01-01,u,a,k,o,
c3,2024-01-01 00:00:03,2024-01-02,u,a,k,o,1e
c4,2024-01-01 00:00:04,2024-01-02,u,a,k
c5,2024-01-01 00:00:05,2024-01-02,u,a,k,o,7,8
c6, ,2024-01-02,u,a,k,o,   
"""


@pytest.fixture
def csv(tmp_path):
    (tmp_path / "ods_conversion_log.csv").write_text(LINES)
    return str(tmp_path / "ods_conversion_log.csv")


def test_losses(spark, csv, tmp_path):
    """Text that did not become a value counts, blank text does not; short and long lines are kept whole beside the row."""
    landed, losses = landing.land_counted(spark, "conversion_log", csv)
    kept = {r.conv_id: r.malformed_line for r in landed.collect()}
    assert {c for c, line in kept.items() if line} == {"c4", "c5"} and kept["c5"].endswith(",7,8")
    w = wh.Warehouse(spark, str(tmp_path / "w"))
    assert w.store("ods.conversion_log", landed, losses=losses) == 6
    found = {m.measure: (m.matching_rows, m.total_rows) for m in w.measures}
    assert found == {"conv_time lost": (1, 6), "gmv_amount lost": (1, 6), "malformed line": (2, 6)}
    stored = w.read("ods.conversion_log")
    assert sorted(stored.columns) == sorted([*wh.TABLES["ods.conversion_log"].names, "dt"]) and stored.count() == 6
    checks = {r.check_name: (r.bad_rows, r.passed) for r in quality.as_checks(spark, w.measures).collect()}
    assert checks["malformed line"] == (2, None)
    quality.enforce(quality.as_checks(spark, w.measures))


def test_counts_of_empty_tables(spark, tmp_path):
    table = Table("t", "none", "a int")
    counted = sinks.store_days(spark.createDataFrame([], "a int, dt string"), table, str(tmp_path / "none"), measures={"odd": F.col("a") % 2 == 1})
    assert counted.counts() == (0, {"odd": 0})


def test_counts_behind_the_exchange(spark, tmp_path):
    """The counters stand in the stage that writes, which Spark counts once whatever it has to repeat."""
    table = Table("t", "many", "a int")
    df = spark.range(100).selectExpr("CAST(id AS INT) AS a", "CAST(id % 3 AS STRING) AS dt", "id AS other")
    counted = sinks.Counted(df, table, {"odd": F.col("other") % 2 == 1, "null": F.col("other").isNull()})
    plan = counted.rows._jdf.queryExecution().toString()
    assert plan.rindex("CollectMetrics") < plan.rindex("Exchange")
    sinks._write_days(counted.rows, str(tmp_path / "many"))
    assert counted.counts() == (100, {"odd": 50, "null": 0})


def test_replaced_table_survives_a_failed_write(spark, tmp_path):
    table = Table("swap_test", "whole", "a int", partitioned=False)
    path = str(tmp_path / "whole")
    sinks.declare_table(spark, table, path)
    sinks.write_whole(spark.range(3).selectExpr("CAST(id AS INT) AS a"), table, path)
    first = sinks.location_of(spark, table.full_name)
    bad = spark.range(3).selectExpr("CAST(raise_error('no') AS INT) AS a")
    with pytest.raises(Exception, match="no"):
        sinks.write_whole(bad, table, path)
    assert sinks.location_of(spark, table.full_name) == first
    open_query = spark.table(table.full_name)
    sinks.write_whole(spark.range(7).selectExpr("CAST(id AS INT) AS a"), table, path)
    assert open_query.count() == 3 and spark.table(table.full_name).count() == 7
    sinks.remove(spark, first.removeprefix("file:"))
    assert spark.table(table.full_name).count() == 7


def test_days_without_a_job(spark, tmp_path):
    path = str(tmp_path / "days")
    df = spark.range(30).selectExpr("CAST(id AS INT) AS a", "concat('2024-01-0', 1 + id % 4) AS dt")
    sinks.write_days(df, path)
    spark.sparkContext.setJobGroup("listing", "days of a directory")
    try:
        assert tables.partition_days(spark, "no.such", path) == [f"2024-01-0{i}" for i in range(1, 5)]
        assert tables.partition_days(spark, "no.such", path + "/none") == []
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("listing")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    sizes = tables.file_sizes(spark, path).orderBy("dt").collect()
    assert [(r.dt, r.files, r.row_cnt) for r in sizes][:2] == [("2024-01-01", 1, 8), ("2024-01-02", 1, 8)]


def test_verdict(spark):
    rows = [("a", "t", "one", 0, True), ("a", "t", "two", 3, False), ("b", "t", "three", 9, None), ("b", "u", "four", 1, False)]
    schema = "layer string, table_name string, check_name string, bad_rows bigint, passed boolean"
    outcome = quality.verdict(spark.createDataFrame(rows, schema)).first()
    assert tuple(outcome) == (False, 2, "a.t: two: 3 rows\nb.u: four: 1 rows")
    assert tuple(quality.verdict(spark.createDataFrame(rows[:1], schema)).first()) == (True, 0, "")


def test_null_counts_of_absent_columns(spark):
    found = quality.null_counts(spark.createDataFrame([(1, None), (2, None)], "a int, b int"), ["a", "b", "c"])
    assert {r.column_name: r.null_rows for r in found.collect()} == {"a": 0, "b": 2, "c": 2}


def test_local_warehouse_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from adloom.session import shared_folder

    def session(master, **conf):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)))

    local = {"spark_sql_warehouse_dir": "file:/here/warehouse/"}
    assert shared_folder(session("local[8]", **local)) == "file:/here/warehouse"
    assert shared_folder(session("yarn", **local, spark_checkpoint_dir="s3a://b/c/")) == "s3a://b/c"
    assert shared_folder(session("yarn", spark_sql_warehouse_dir="hdfs:/w")) == "hdfs:/w"
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(session(master, **local))


def test_files_are_sized_by_a_rebalance(spark):
    df = spark.range(10).selectExpr("CAST(id AS INT) AS a", "'x' AS dt")
    plan = sinks.sized(df, "dt")._jdf.queryExecution().toString()
    assert "RebalancePartitions [dt" in plan or "REBALANCE_PARTITIONS_BY_COL" in plan
