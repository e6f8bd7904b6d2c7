"""Physical plans: what is read, what is shuffled, and what Catalyst removes."""

import io
import re
from contextlib import redirect_stdout

import pytest
from support import SMALL
from pyspark.sql import functions as F

from adloom.plans.queries import REGISTRY, Layers
from adloom.plans.stored_queries import WRITING


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_no_query_uses_a_cross_join_or_python(spark):
    writes = {"dq_report", "overwrite_day", "first_nonempty_cost", *WRITING}
    for name, build in REGISTRY.items():
        if name in writes or name.startswith("land_"):
            continue
        text = plan(build(spark, SMALL))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
            assert bad not in text, (name, bad)


def test_campaign_metrics_drop_unused_dimension_joins(spark):
    text = plan(Layers(spark, SMALL).campaign_daily)
    assert "Join" not in text and "part.parquet" not in text and "nation.parquet" not in text
    # One exchange for copies of events, one for copies of conversions, one for cost, one for the totals.
    assert text.count("Exchange hashpartitioning") == 4


def test_copies_are_cut_before_the_exchange(spark):
    text = plan(Layers(spark, SMALL).traffic)
    head, tail = text.split("Exchange hashpartitioning(dt", 1)
    assert "WindowGroupLimit" in head and "WindowGroupLimit" in tail


def test_unused_columns_are_not_read(spark):
    text = plan(Layers(spark, SMALL).day_cost)
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert "event_id" not in schema and "user_id" not in schema


def test_filters_reach_the_scan(spark):
    text = plan(Layers(spark, SMALL).conversions)
    assert "EqualTo(event_type,purchase)" in text


def test_ranking_uses_one_exchange_for_both_orders(spark):
    x = Layers(spark, SMALL)
    ranked, base = plan(x.ranking), plan(x.campaign_daily)
    assert ranked.count("Exchange") == base.count("Exchange") + 1


@pytest.mark.parametrize("limit,expected", [(10 * 2**20, "BroadcastHashJoin"), (-1, "SortMergeJoin")])
def test_dimension_joins_follow_the_size_limit(spark, limit, expected, rows):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    x = Layers(spark, SMALL)
    want = rows(x.impressions.select("dt", "event_id", "advertiser_id", "slot_type"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        df = Layers(spark, SMALL).impressions.select("dt", "event_id", "advertiser_id", "slot_type")
        assert expected in plan(df)
        assert rows(df) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_hot_event_sends_one_row_per_task(spark):
    """A third of all rows are copies of one event: the final window receives at most one of them per map task."""
    from adloom.operators.clean import newest

    n = 30_000
    df = spark.range(0, n, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), "id")).alias("event_id"),
        F.lit("2024-01-01").alias("dt"),
        F.timestamp_seconds("id").alias("event_time"),
    )
    unique = newest(df, ["dt", "event_id"], "event_time")
    assert unique.count() == n - n // 3 + 1
    assert unique.where("event_id = 'hot'").first().event_time.timestamp() == n - 3


def test_map_reads_the_facts_once(spark, tmp_path):
    """The pairs are used twice, but their exchange is shared."""
    from adloom.operators.metrics import campaign_advertiser_map

    path = str(tmp_path / "traffic")
    Layers(spark, SMALL).traffic.write.parquet(path)
    df = campaign_advertiser_map(spark.read.parquet(path))
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_overview_goes_through_the_facts_once(spark):
    """Copies of events are removed once, and one exchange by user serves the totals and the active users."""
    text = plan(Layers(spark, SMALL).overview)
    # Events and conversions: a window each, with a group limit on both sides of its exchange.
    assert text.count("WindowGroupLimit") == 4 and "Join" not in text


def test_salt_needs_no_join(spark):
    x = Layers(spark, SMALL)
    from adloom.operators import skew

    assert "Join" not in plan(skew.campaign_totals_salted(x.events, {"cmp_1": 4, "cmp_2": 2}, distributed=True))
