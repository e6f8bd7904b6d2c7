"""Exact sums of money and rates rounded once."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from adloom.functions import ratios
from adloom.operators import metrics, reports

SEEN = "dt string, event_time timestamp, user_id string, campaign_id string, advertiser_id string, event_type string"


def half_up(num: Decimal, den: Decimal) -> float:
    return float((num / den).quantize(Decimal("0.00001"), ROUND_HALF_UP)) if den else 0.0


@pytest.mark.parametrize(
    "num, den, want",
    [
        ("1", "200000", 0.00001),
        ("1.000000", "400000", 0.0),
        ("0.0000149999", "1", 0.00001),
        ("-1", "200000", -0.00001),
        ("-7", "-3", 2.33333),
        ("12345678901.23", "3", 4115226300.41),
        ("0.1", "0", 0.0),
    ],
)
def test_rounded_once(spark, num, den, want):
    row = spark.range(1).select(ratios.money_ratio(F.lit(num).cast("decimal(28, 10)"), F.lit(den).cast("decimal(28, 10)")).alias("r")).first()
    assert row.r == want


def test_rates_of_random_sums(spark):
    rng = random.Random(4)
    pairs = [(str(rng.randrange(10**15) / 100), str(rng.randrange(1, 10 ** rng.randrange(1, 14)) / 100)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ratios.roi(F.col("a"), F.col("b")).alias("r"))
    for a, b, r in df.collect():
        a, b = Decimal(a).quantize(Decimal("1e-10")), Decimal(b).quantize(Decimal("1e-10"))
        assert r == (half_up(a, b) if a < b * 10**12 else float(a) / float(b))


def test_sums_do_not_depend_on_order(spark):
    """Sums above ten billion with cents: every order of the rows gives the same figures, and the right ones."""
    rng = random.Random(8)
    amounts = [rng.choice([rng.randrange(10**12) / 100, rng.randrange(1, 100) / 100]) for _ in range(4000)]
    conversions = [("2024-01-01", f"k{i % 3}", f"a{i % 5}", f"u{i % 7}", x) for i, x in enumerate(amounts)]
    cost = [("2024-01-01", f"k{i}", 1234567.89 * (i + 1)) for i in range(3)]
    seen = [("2024-01-01", None, f"u{i}", f"k{i % 3}", f"a{i % 5}", "impression") for i in range(15)]
    seen_df = spark.createDataFrame(seen, SEEN)
    cost_df = spark.createDataFrame(cost, "dt string, campaign_id string, cost double")
    results = []
    for partitions in (1, 7, 16):
        rng.shuffle(conversions)
        conv = spark.createDataFrame(conversions, "dt string, campaign_id string, advertiser_id string, user_id string, gmv_amount double")
        conv = conv.withColumn("conv_time", F.lit(None).cast("timestamp")).repartition(partitions)
        by_campaign = metrics.campaign_daily(seen_df, conv, cost_df)
        by_advertiser = metrics.advertiser_daily(seen_df, conv, cost_df)
        overview = reports.kpi_overview(by_campaign, metrics.user_daily(seen_df, conv))
        results.append([sorted(map(tuple, df.collect())) for df in (by_campaign, by_advertiser, overview)])
    assert results[0] == results[1] == results[2]
    exact = {}
    for _, k, _, _, x in conversions:
        exact[k] = exact.get(k, Decimal(0)) + Decimal(repr(x))
    for row in by_campaign.collect():
        spent = Decimal(repr(dict((k, c) for _, k, c in cost)[row.campaign_id])).quantize(Decimal("0.000001"), ROUND_HALF_UP)
        assert row.gmv_amount == float(exact[row.campaign_id]) and row.roi == half_up(exact[row.campaign_id], spent)
        assert row.rpm == half_up(exact[row.campaign_id] * 1000, Decimal(row.impressions))


def test_amounts_that_are_none(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (2.5,)], "x double")
    assert [r.m for r in df.select(ratios.money(F.col("x")).alias("m")).collect()] == [None, None, None, Decimal("2.5000000000")]
