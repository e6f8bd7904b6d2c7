import datetime as d
import random

import pytest

from adloom.operators import tags

USER_DAILY = "dt string, user_id string, imp_cnt bigint, clk_cnt bigint, conv_cnt bigint, gmv_amount double, " \
    "active_campaign_cnt bigint, last_event_time timestamp, ctr double, cvr double"


@pytest.fixture(scope="module")
def user_daily(spark):
    rng = random.Random(3)
    data = []
    for user in range(25):
        for day in range(20):
            if rng.random() < 0.5:
                dt = (d.date(2024, 2, 20) + d.timedelta(days=day)).isoformat()
                imp, clk, conv = rng.randrange(25), rng.randrange(4), rng.randrange(2)
                t = d.datetime.fromisoformat(dt) + d.timedelta(minutes=rng.randrange(1400))
                data.append((dt, f"u{user}", imp, clk, conv, rng.randrange(0, 20000) / 100, 1, t, 0.0, 0.0))
    data.append(("2024-03-01", None, 0, 0, 0, 0.0, 0, None, 0.0, 0.0))
    return spark.createDataFrame(data, USER_DAILY).cache()


def test_window_equals_one_day_form(user_daily, rows):
    everything = tags.user_tag_snapshot(user_daily)
    for day in ("2024-02-20", "2024-02-29", "2024-03-01", "2024-03-10"):
        one = tags.user_tag_snapshot(user_daily, day)
        numeric = [c for c in one.columns if c != "feature_7d_gmv"]
        assert rows(one, *numeric) == rows(everything.where(f"dt = '{day}'"), *numeric)
        a = {r.user_id: r.feature_7d_gmv for r in one.collect()}
        b = {r.user_id: r.feature_7d_gmv for r in everything.where(f"dt = '{day}'").collect()}
        assert a == pytest.approx(b)


def test_missing_user_has_zero_features(user_daily):
    row = tags.user_tag_snapshot(user_daily, "2024-03-01").where("user_id is null").first()
    assert row.tags == [] and row.tag_cnt == 0 and row.feature_7d_impressions == 0 and row.last_event_time is None


@pytest.mark.parametrize(
    "values,expected",
    [
        (dict(feature_7d_active_days=3), ["high_active_7d"]),
        (dict(feature_7d_ctr=0.04, feature_7d_impressions=50), ["high_ctr_7d"]),
        (dict(feature_7d_ctr=0.04, feature_7d_impressions=49), []),
        (dict(feature_7d_cvr=0.06, feature_7d_clicks=10), ["high_cvr_7d"]),
        (dict(feature_7d_gmv=300.0), ["high_value_7d"]),
        (dict(feature_day_clicks=3), ["ad_clicker"]),
        (dict(feature_day_impressions=20, feature_day_clicks=1), ["ad_viewer"]),
        (dict(feature_day_conversions=1), ["converter"]),
        (dict(feature_day_impressions=1), ["bounce_user"]),
        (dict(feature_7d_active_days=7, feature_day_clicks=5, feature_day_conversions=2),
         ["high_active_7d", "ad_clicker", "converter"]),
    ],
)
def test_rules(spark, values, expected):
    base = dict(dt="2024-01-01", user_id="u", feature_7d_impressions=0, feature_7d_clicks=0, feature_7d_conversions=0,
                feature_7d_gmv=0.0, feature_7d_active_days=0, feature_7d_ctr=0.0, feature_7d_cvr=0.0,
                feature_day_impressions=0, feature_day_clicks=0, feature_day_conversions=0, feature_day_gmv=0.0,
                last_event_time="")
    row = tags.attach_tags(spark.createDataFrame([{**base, **values}])).first()
    assert row.tags == expected and row.tag_cnt == len(expected)


def test_rules_compare_the_rounded_rate(spark):
    daily = spark.createDataFrame(
        [("2024-01-01", "u", 100_000, 3_999, 0, 0.0, 1, d.datetime(2024, 1, 1), 0.0, 0.0)], USER_DAILY
    )
    # 3999 / 100000 = 0.03999 stays below; 39996 / 1000000 = 0.039996 rounds up to the limit.
    assert "high_ctr_7d" not in tags.user_tag_snapshot(daily, "2024-01-01").first().tags
    more = spark.createDataFrame(
        [("2024-01-01", "u", 1_000_000, 39_996, 0, 0.0, 1, d.datetime(2024, 1, 1), 0.0, 0.0)], USER_DAILY
    )
    assert "high_ctr_7d" in tags.user_tag_snapshot(more, "2024-01-01").first().tags


def test_quality_has_every_tag_every_day(user_daily):
    snapshot = tags.user_tag_snapshot(user_daily)
    got = tags.tag_quality_daily(snapshot).collect()
    names = {r.tag_name for r in tags.TAG_RULES}
    by_day = {}
    for r in got:
        by_day.setdefault(r.dt, []).append(r)
        assert r.tagged_user_cnt <= r.total_user_cnt and 0 <= r.coverage_rate <= 1
    assert all({r.tag_name for r in v} == names and len(v) == len(names) for v in by_day.values())

    exploded = tags.tag_rows(snapshot).where("tag_name is not null").groupBy("dt", "tag_name").agg({"user_id": "count"})
    want = {(r[0], r[1]): r[2] for r in exploded.collect()}
    assert {(r.dt, r.tag_name): r.tagged_user_cnt for r in got if r.tagged_user_cnt} == want
    one = tags.tag_quality_daily(snapshot, "2024-03-01").collect()
    assert {r.tag_name: r.tagged_user_cnt for r in one} == {
        r.tag_name: r.tagged_user_cnt for r in by_day["2024-03-01"]
    }


def test_quality_of_an_empty_day(user_daily):
    got = tags.tag_quality_daily(tags.user_tag_snapshot(user_daily), "1999-01-01").collect()
    assert len(got) == len(tags.TAG_RULES)
    assert all((r.tagged_user_cnt, r.total_user_cnt, r.coverage_rate, r.avg_gmv_tagged) == (0, 0, 0.0, 0.0) for r in got)


def test_dictionary(spark):
    got = tags.tag_dictionary(spark).collect()
    assert [r.tag_id for r in got] == [f"tag_{i:04d}" for i in range(1, 9)]
    assert all(r.update_freq == "daily" and r.create_time is not None for r in got)
