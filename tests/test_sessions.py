"""Sessions against a row-by-row computation."""

import datetime as d
import random

import pytest
from pyspark.sql import functions as F

from adloom.operators.sessions import sessionize

BASE = d.datetime(2024, 1, 1)


def brute(events, gap=30, first=1):
    out = {}
    last, number = {}, {}
    for event_id, t, dt, user in sorted(events, key=lambda e: (e[2], e[3], e[1])):
        key = (dt, user)
        if key not in last or t - last[key] > d.timedelta(minutes=gap):
            number[key] = number.get(key, first - 1) + 1
        last[key] = t
        out[event_id] = f"sess_{dt.replace('-', '')}_{user}_{number[key]:03d}"
    return out


@pytest.fixture(scope="module")
def events():
    rng = random.Random(7)
    data = []
    for i in range(3000):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(40)}"
        day = rng.randrange(3)
        t = BASE + d.timedelta(days=day, microseconds=rng.randrange(86_400_000_000))
        data.append((f"e{i}", t, f"2024-01-{day + 1:02d}", user))
    # Exactly the gap stays in the session, a microsecond more does not; the day of a late event stays its ``dt``.
    data += [("x0", BASE + d.timedelta(hours=5), "2024-01-01", "edge"),
             ("x1", BASE + d.timedelta(hours=5, minutes=30), "2024-01-01", "edge"),
             ("x2", BASE + d.timedelta(hours=6, microseconds=1), "2024-01-01", "edge"),
             ("x3", BASE + d.timedelta(hours=24, minutes=10), "2024-01-01", "edge")]
    return data


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("gap", [30, 7, 45])
def test_equals_brute_force(spark, events, kind, gap):
    df = spark.createDataFrame(events, f"event_id string, event_time {kind}, dt string, user_id string").repartition(5)
    got = {r.event_id: r.session_id for r in sessionize(df, gap_minutes=gap).collect()}
    assert got == brute(events, gap)


def test_first_number_and_wide_numbers(spark):
    many = [(f"e{i}", BASE + d.timedelta(minutes=i), "2024-01-01", "u") for i in range(1200)]
    df = spark.createDataFrame(many, "event_id string, event_time timestamp, dt string, user_id string")
    got = {r.event_id: r.session_id for r in sessionize(df, gap_minutes=1, first_number=2).collect()}
    assert set(got.values()) == {"sess_20240101_u_002"}
    sparse = [(f"e{i}", BASE + d.timedelta(minutes=i), "2024-01-01", "u") for i in range(0, 2400, 2)]
    df = spark.createDataFrame(sparse, "event_id string, event_time timestamp, dt string, user_id string")
    got = {r.event_id: r.session_id for r in sessionize(df, gap_minutes=1).collect()}
    assert got["e0"] == "sess_20240101_u_001" and got["e2398"] == "sess_20240101_u_1200"


def test_rows_without_time_or_user_stay(spark):
    data = [("a", BASE, "2024-01-01", "u"), ("b", None, "2024-01-01", "u"), ("c", BASE, "2024-01-01", None)]
    df = spark.createDataFrame(data, "event_id string, event_time timestamp, dt string, user_id string")
    got = {r.event_id: r.session_id for r in sessionize(df).collect()}
    assert got == {"a": "sess_20240101_u_001", "b": None, "c": None}


def test_all_rows_kept(spark, events):
    df = spark.createDataFrame(events, "event_id string, event_time timestamp, dt string, user_id string")
    assert sessionize(df).agg(F.count_distinct("event_id")).first()[0] == len(events)
