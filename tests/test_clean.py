import datetime as d

import pytest
from pyspark.sql import functions as F

from adloom.functions import labels, ratios
from adloom.operators import clean, enrich
from adloom.sources import landing, tables

T0 = d.datetime(2024, 1, 1, 10, 0, 0)
EVENT = "event_id string, event_time timestamp, dt string, user_id string, ad_id string, campaign_id string, " \
    "creative_id string, site_id string, event_type string, device string, is_valid int"


def event(event_id, minute=0, kind="impression", valid=1, ad="a1", campaign="c1", user="u1", dt="2024-01-01"):
    time = T0 + d.timedelta(minutes=minute)
    return (event_id, time, dt, user, ad, campaign, "crt", "site", kind, "ios", valid)


def ads(spark, *more):
    data = [("a1", "c1", "adv1", "video", "app", "p1", "2024-01-01", "2024-02-01"), *more]
    return clean.ad_dimension(
        spark.createDataFrame(
            data,
            "ad_id string, campaign_id string, advertiser_id string, ad_type string, landing_type string, "
            "product_id string, start_dt string, end_dt string",
        )
    )


def slots(spark):
    return clean.slot_dimension(
        spark.createDataFrame(
            [("s1", "feed", "main", "top", "1.5")],
            "ad_slot_id string, slot_type string, app string, position string, price_factor string",
        )
    )


def test_ratio_rounds_half_up_and_guards_zero(spark):
    df = spark.createDataFrame([(23, 320), (1, 3), (5, 0), (5, None), (None, 5)], "n bigint, d bigint")
    got = [r[0] for r in df.select(ratios.safe_ratio(F.col("n"), F.col("d"))).collect()]
    assert got == [0.07188, 0.33333, 0.0, 0.0, 0.0]


def test_money_ratio_ignores_summation_noise(spark):
    noisy = 2820.0499999999997
    df = spark.createDataFrame([(noisy, 128)], "g double, i bigint")
    assert df.select(ratios.rpm(F.col("g"), F.col("i"))).first()[0] == 22031.64063


def test_growth_and_spend(spark):
    df = spark.createDataFrame([(15.0, 10.0), (1.0, 0.0), (1.0, None)], "c double, p double")
    assert [r[0] for r in df.select(ratios.growth_rate(F.col("c"), F.col("p"))).collect()] == [0.5, None, None]
    assert [r[0] for r in df.select(ratios.spend_flag(F.col("p"))).collect()] == [1, 0, 0]


def test_bad_values_become_null(spark):
    raw = spark.createDataFrame([("x", "not a time", "12.5x"), ("y", "2024-01-01 08:00:00", "3")],
                                "conv_id string, conv_time string, gmv_amount string")
    got = {r.conv_id: r for r in landing.type_conversions(raw).collect()}
    assert got["x"].conv_time is None and got["x"].gmv_amount is None
    assert got["y"].conv_time == d.datetime(2024, 1, 1, 8) and got["y"].gmv_amount == 3.0


def test_missing_csv_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        landing.land(spark, "ad_cost", str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError):
        tables.read_parquet(spark, str(tmp_path / "none"))


def test_csv_land(spark, tmp_path):
    (tmp_path / "ods_ad_meta.csv").write_text(
        "ad_id,campaign_id,advertiser_id,ad_type,landing_type,product_id,start_dt,end_dt\n"
        'a1,c1,v1,video,app,,2024-01-01,2024-13-01\na2,c1,v1,video,app,"",2024-01-02,2024-02-01\n'
        "a3,c1,v1,video,app,p9,2024-01-02,2024-02-01\n"
    )
    got = {r.ad_id: r for r in landing.land(spark, "ad_meta", str(tmp_path / "ods_ad_meta.csv")).collect()}
    assert [got[a].product_id for a in ("a1", "a2", "a3")] == [None, None, "p9"]
    assert got["a1"].end_dt is None and got["a2"].end_dt == d.date(2024, 2, 1)


def test_standard_events_fills_late_columns_and_keeps_fractions(spark):
    raw = spark.createDataFrame([event("e1")], EVENT).drop("is_valid").withColumn(
        "event_time", F.col("event_time") + F.expr("INTERVAL '0.25' SECOND")
    )
    row = clean.standard_events(raw).first()
    assert row.is_valid == 1 and row.session_id is None and row.event_time.microsecond == 250000


def test_newest_is_deterministic_on_ties(spark, rows):
    data = [("k", T0, "b"), ("k", T0, "a"), ("k", None, "z"), ("j", None, "q")]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "id string, t timestamp, v string").repartition(3)
        assert rows(clean.newest(df, ["id"], "t"), "id", "v") == [("j", "q"), ("k", "b")]


def test_detail_is_unique_even_with_repeated_dimension_keys(spark, rows):
    events = clean.standard_events(
        spark.createDataFrame(
            [event("e1", 0), event("e1", 5), event("e1", 1, "click"), event("e2", valid=0), event("e3", valid=None),
             event("e4", ad="unknown"), event("e5", kind="other")],
            EVENT,
        )
    )
    repeated = ads(spark, ("a1", "c1", "adv0", "video", "app", "", "2024-01-01", "2024-02-01"))
    both = enrich.event_detail(events, repeated, slots(spark))
    expected = [("e1", "click", "adv0"), ("e1", "impression", "adv0"), ("e3", "impression", "adv0"),
                ("e4", "impression", None)]
    assert rows(both, "event_id", "event_type", "advertiser_id") == expected
    split = enrich.impression_detail(events, repeated, slots(spark)).unionByName(
        enrich.click_detail(events, repeated, slots(spark))
    )
    assert rows(split) == rows(both)
    assert both.where("event_id = 'e1' and event_type = 'impression'").first().event_time == T0 + d.timedelta(minutes=5)
    # Applying the deduplication to its own result changes nothing.
    assert rows(clean.newest(both, enrich.EVENT_KEYS, "event_time")) == rows(both)
    lean = enrich.lean_traffic(events, repeated)
    assert rows(lean, "event_id", "event_type", "advertiser_id") == expected


def test_highest_cost_wins(spark, rows):
    cost = spark.createDataFrame(
        [("d", "c1", 1.0), ("d", "c1", 3.0), ("d", "c1", None), ("d", None, 9.0), ("d", "c2", None)],
        "dt string, campaign_id string, cost double",
    )
    assert rows(clean.campaign_day_cost(cost)) == [("d", "c1", 3.0), ("d", "c2", None)]


def test_labels(spark):
    df = spark.createDataFrame([("ios",), ("android",), ("pc",), (None,)], "device string")
    got = df.select(labels.device_type(F.col("device")).alias("k")).select("k", labels.user_agent_label(F.col("k")))
    assert [tuple(r) for r in got.collect()] == [
        ("ios", "ios_app"), ("android", "android_app"), ("web", "web"), ("web", "web")
    ]
    import hashlib

    names = [f"cmp_{i:04d}" for i in range(50)]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    want = [int(hashlib.md5(n.encode()).hexdigest()[:8], 16) % 50 for n in names]
    assert [r[0] for r in df.select(labels.md5_bucket(F.col("c"), 50)).collect()] == want


def test_first_nonempty(spark):
    empty = spark.createDataFrame([], "dt string, cost double")
    full = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0)], "dt string, cost double")
    assert [tuple(r) for r in tables.first_nonempty([empty, full], "2024-01-02").collect()] == [("2024-01-02", 2.0)]
    with pytest.raises(LookupError):
        tables.first_nonempty([empty, full], "2024-01-03")


def test_scratch_folder_is_the_shared_one(spark):
    from adloom.session import scratch_dir

    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first.startswith(shared) and first != second
