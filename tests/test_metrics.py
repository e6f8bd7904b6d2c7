import datetime as d

import pytest
from pyspark.sql import functions as F

from adloom.operators import metrics, profile, reports

T0 = d.datetime(2024, 1, 1, 10)
DT, NEXT = "2024-01-01", "2024-01-02"


def facts(spark, seen=(), conversions=(), cost=()):
    """seen: (dt, type, user, campaign, advertiser); conversions: (dt, user, campaign, advertiser, gmv)."""
    s = spark.createDataFrame(
        [(dt, T0, u, c, a, kind) for dt, kind, u, c, a in seen],
        "dt string, event_time timestamp, user_id string, campaign_id string, advertiser_id string, event_type string",
    )
    v = spark.createDataFrame(
        [(dt, T0 + d.timedelta(hours=1), u, c, a, g) for dt, u, c, a, g in conversions],
        "dt string, conv_time timestamp, user_id string, campaign_id string, advertiser_id string, gmv_amount double",
    )
    k = spark.createDataFrame(list(cost), "dt string, campaign_id string, cost double")
    return s, v, k


def test_missing_keys(spark, rows):
    s, v, k = facts(
        spark,
        [(DT, "impression", "u", None, "a"), (DT, "impression", None, "c", "a"), (DT, "click", "u", "c", None)],
        [(DT, None, None, None, 5.0)],
    )
    daily = metrics.campaign_daily(s, v, k)
    assert rows(daily, "campaign_id", "impressions", "clicks", "conversions", "gmv_amount") == [
        ("c", 1, 1, 0, 0.0), (None, 0, 0, 0, 0.0)
    ]
    assert [r[0] for r in rows(metrics.advertiser_daily(s, v, k), "advertiser_id")] == ["a"]
    users = metrics.user_daily(s, v)
    assert rows(users, "user_id", "imp_cnt", "clk_cnt", "conv_cnt", "last_event_time") == [
        ("u", 1, 1, 0, T0), (None, 0, 0, 0, None)
    ]


def test_rates_of_campaign(spark):
    s, v, k = facts(
        spark,
        [(DT, "impression", "u", "c", "a")] * 3 + [(DT, "click", "u", "c", "a")] * 2,
        [(DT, "u", "c", "a", 10.0)],
        [(DT, "c", 4.0), (DT, "only_cost", 2.0)],
    )
    got = {r.campaign_id: r for r in metrics.campaign_daily(s, v, k).collect()}
    c = got["c"]
    assert (c.ctr, c.cvr, c.rpm, c.roi) == (0.66667, 0.5, 3333.33333, 2.5)
    o = got["only_cost"]
    assert (o.impressions, o.cost, o.ctr, o.cvr, o.rpm, o.roi) == (0, 2.0, 0.0, 0.0, 0.0, 0.0)


def test_active_campaigns_is_the_larger_count_not_the_union(spark):
    s, v, _ = facts(
        spark,
        [(DT, "impression", "u", "c1", "a"), (DT, "impression", "u", "c2", "a"), (DT, "click", "u", "c3", "a"),
         (DT, "click", "u", None, "a")],
    )
    row = metrics.user_daily(s, v).first()
    assert (row.active_campaign_cnt, row.imp_cnt, row.clk_cnt) == (2, 2, 2)


def test_map_falls_back_per_whole_day(spark, rows):
    seen = [
        (DT, "impression", "u", "c1", "a1"), (DT, "click", "u", "c2", "a2"),
        (NEXT, "impression", "u", "c1", None), (NEXT, "click", "u", "c1", "a1"), (NEXT, "click", "u", "c1", "a2"),
    ]
    s, v, k = facts(spark, seen, (), [(DT, "c1", 6.0), (DT, "c2", 4.0), (NEXT, "c1", 8.0), (NEXT, "c9", None)])
    assert rows(metrics.campaign_advertiser_map(s)) == [
        (DT, "c1", "a1"), (NEXT, "c1", "a1"), (NEXT, "c1", "a2")
    ]
    # c2 has clicks only on a day with mapped impressions: its cost stays with no advertiser.
    assert rows(metrics.advertiser_cost_split(s, k)) == [
        (DT, "a1", 6.0), (DT, None, 4.0), (NEXT, "a1", 4.0), (NEXT, "a2", 4.0), (NEXT, None, 0.0)
    ]
    daily = metrics.advertiser_daily(s, v, k)
    assert rows(daily, "dt", "advertiser_id", "clicks", "cost") == [
        (DT, "a1", 0, 6.0), (DT, "a2", 1, 0.0), (NEXT, "a1", 1, 4.0), (NEXT, "a2", 1, 4.0)
    ]


@pytest.mark.parametrize("advertisers", [1, 3, 7])
def test_cost_is_conserved(spark, advertisers):
    seen = [(DT, "impression", "u", f"c{i % 5}", f"a{i % advertisers}") for i in range(60)]
    cost = [(DT, f"c{i}", float(i + 1)) for i in range(8)]
    s, _, k = facts(spark, seen, (), cost)
    split = metrics.advertiser_cost_split(s, k).collect()
    assert sum(r.cost for r in split) == pytest.approx(sum(c for *_, c in cost))


def test_overview_equals_campaign_sums_and_counts_null_user(spark):
    s, v, k = facts(
        spark,
        [(DT, "impression", f"u{i % 4}", f"c{i % 3}", "a") for i in range(20)] + [(DT, "click", None, "c1", "a")],
        [(DT, "u1", "c1", "a", 7.5), (DT, "u2", "c2", "a", 2.5)],
        [(DT, "c1", 4.0), (DT, "c2", 1.0)],
    )
    campaigns, users = metrics.campaign_daily(s, v, k), metrics.user_daily(s, v)
    row = reports.kpi_overview(campaigns, users).first()
    assert (row.impressions, row.clicks, row.conversions, row.gmv, row.cost) == (20, 1, 2, 10.0, 5.0)
    assert (row.active_users, row.arpu, row.roi, row.rpm, row.ctr) == (5, 2.0, 2.0, 500.0, 0.05)


def test_ranking_ties_by_id_and_values_are_rounded_first(spark, rows):
    daily = spark.createDataFrame(
        [(DT, c, 1, 0, 0, g, 1.0, 0.0, 0.0, 0.0, r) for c, g, r in
         [("b", 1.000001, 2.0), ("a", 1.000002, 2.0), ("c", 5.0, 0.0), ("z", 1.000004, 3.0)]],
        "dt string, campaign_id string, impressions bigint, clicks bigint, conversions bigint, gmv_amount double, "
        "cost double, ctr double, cvr double, rpm double, roi double",
    )
    ranked = reports.campaign_ranking(daily)
    assert rows(ranked, "campaign_id", "rank_by_gmv", "rank_by_roi") == [
        ("a", 2, 2), ("b", 3, 3), ("c", 1, 4), ("z", 4, 1)
    ]
    assert [r.campaign_id for r in reports.top_campaigns(ranked, DT, 2, "roi").collect()] == ["z", "a"]


def advertiser_rows(spark, data):
    return spark.createDataFrame(
        [(dt, a, 1, 0, 0, g, k, 0.0, 0.0, 0.0, 0.0) for dt, a, g, k in data],
        "dt string, advertiser_id string, impressions bigint, clicks bigint, conversions bigint, gmv_amount double, "
        "cost double, ctr double, cvr double, rpm double, roi double",
    )


def test_growth_needs_the_day_before(spark, rows):
    daily = advertiser_rows(
        spark,
        [("2024-02-28", "a", 10.0, 0.0), ("2024-02-29", "a", 15.0, 1.0), ("2024-03-01", "a", 0.0, 1.0),
         ("2024-03-02", "a", 5.0, 0.0), ("2024-02-28", "gap", 10.0, 0.0), ("2024-03-01", "gap", 20.0, 0.0)],
    )
    everything = reports.advertiser_dashboard(daily)
    assert rows(everything, "advertiser_id", "dt", "revenue_growth_rate", "retention_flag") == [
        ("a", "2024-02-28", None, 0), ("a", "2024-02-29", 0.5, 1), ("a", "2024-03-01", -1.0, 1),
        ("a", "2024-03-02", None, 0), ("gap", "2024-02-28", None, 0), ("gap", "2024-03-01", None, 0),
    ]
    for day in ("2024-02-28", "2024-02-29", "2024-03-01", "2024-03-02"):
        assert rows(reports.advertiser_dashboard(daily, day)) == rows(everything.where(f"dt = '{day}'"))


def test_traffic_counts_and_media_cost(spark, rows):
    s, _, _ = facts(
        spark,
        [(DT, "impression", "u", "c1", "a")] * 2 + [(DT, "click", "u", "c2", "a"), (DT, "click", "u", None, "a")],
    )
    counts = profile.traffic_counts(s)
    assert rows(counts) == [(DT, "c1", 2, 0), (DT, "c2", 0, 1)]
    prices = spark.createDataFrame([("c1", 10.0, 0.5)], "campaign_id string, cpm double, cpc double")
    assert rows(profile.media_cost(counts, prices)) == [(DT, "c1", 0.02), (DT, "c2", 1.0)]


def test_device_preference_breaks_ties_alphabetically(spark, rows):
    data = [("u", "pc"), ("u", "ios"), ("v", "ios"), ("v", "android"), ("w", "h5"), ("w", "pc"), ("w", "ios")]
    df = spark.createDataFrame(data, "user_id string, device string")
    assert rows(profile.user_device_preference(df)) == [("u", "ios"), ("v", "android"), ("w", "web")]


def test_product_distribution(spark):
    data = [(f"p{i:03d}",) for i in range(150) for _ in range(1 + (i < 12))] + [("",), (None,)]
    got = profile.product_distribution(spark.createDataFrame(data, "product_id string")).orderBy("rank").collect()
    assert [r.product_id for r in got] == [f"p{i:03d}" for i in range(10)]
    assert got[0].total_nonempty == 162 and got[0].distinct_products == 150
    assert got[0].top_share == round(20 / 162, 5) and got[0].wide_share == round(112 / 162, 5)


def test_narrow_and_wide_rows_break_ties_alike(spark, rows):
    """Copies of one event with the same time but another session, ad and campaign."""
    from adloom.operators import clean, enrich

    raw = spark.createDataFrame(
        [("e1", T0, DT, "u", "s9", "a1", "c1", "click"), ("e1", T0, DT, "u", "s1", "a2", "c2", "click"),
         ("e2", T0, DT, "u", "s1", "a2", "c1", "impression"), ("e2", T0, DT, "u", "s2", "a1", "c2", "impression")],
        "event_id string, event_time timestamp, dt string, user_id string, session_id string, ad_id string,"
        " campaign_id string, event_type string",
    )
    rest = {c: F.lit(None).cast("string") for c in ("creative_id", "site_id", "device")}
    events = clean.standard_events(raw.withColumns(rest))
    ads = spark.createDataFrame(
        [("a1", "c1", "A1"), ("a2", "c2", "A2"), ("a2", "c1", "A3"), ("a1", "c2", "A4")],
        "ad_id string, campaign_id string, advertiser_id string",
    ).withColumns({c: F.lit("x") for c in ("ad_type", "landing_type", "product_id")})
    slots = spark.createDataFrame([], "ad_slot_id string, slot_type string, app string, position string, price_factor double")
    lean = enrich.lean_traffic(events, ads)
    wide = metrics.traffic(enrich.impression_detail(events, ads, slots), enrich.click_detail(events, ads, slots))
    none = spark.createDataFrame([], "dt string, conv_time timestamp, user_id string, campaign_id string, advertiser_id string, gmv_amount double")
    cost = spark.createDataFrame([(DT, "c1", 1.0)], "dt string, campaign_id string, cost double")
    for daily in (metrics.campaign_daily, metrics.advertiser_daily):
        assert rows(daily(lean, none, cost)) == rows(daily(wide, none, cost))
