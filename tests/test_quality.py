import pytest

from adloom.operators import quality
from adloom.operators.quality import TableChecks


def found(report):
    return {r.check_name: r.bad_rows for r in report.collect()}


def test_checks_find_planted_violations(spark):
    df = spark.createDataFrame(
        [("a", 1.5, -1, 5, 3, "t"), ("a", 0.5, 1, 1, 3, "t"), (None, None, 2, 1, 1, "t"), ("b", -0.1, 2, 1, 1, "t")],
        "id string, ctr double, n int, tagged int, total int, event_time string",
    )
    checks = TableChecks(
        "x", "t", not_empty=True, time_columns=("event_time",), required=("id", "absent"), non_negative=("n", "absent"),
        rates=("ctr",), unique_key=("id",), at_most=(("tagged", "total"),),
    )
    report = quality.check_table(df, checks)
    assert found(report) == {
        "not_empty": 0, "event_time is a timestamp": 1, "id not null": 1, "n >= 0": 1, "ctr in [0,1]": 2,
        "tagged <= total": 1, "unique (id)": 1, "absent is a column": 1,
    }
    with pytest.raises(quality.QualityGateError) as error:
        quality.enforce(report)
    assert str(error.value).count("\n") == 7


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, event_time string")
    checks = TableChecks("x", "t", not_empty=True, time_columns=("event_time",), unique_key=("id",))
    assert found(quality.check_table(df, checks)) == {
        "not_empty": 1, "event_time is a timestamp": 1, "unique (id)": 0
    }


def test_finite(spark):
    df = spark.createDataFrame([(float("inf"),), (None,), (1.0,)], "revenue_growth_rate double")
    checks = TableChecks("x", "t", finite=("revenue_growth_rate",))
    assert found(quality.check_table(df, checks)) == {"revenue_growth_rate is finite": 1}


def test_clean_report_passes(spark):
    df = spark.createDataFrame([("a", 0.5)], "id string, ctr double")
    quality.enforce(quality.check_table(df, TableChecks("x", "t", not_empty=True, rates=("ctr",), unique_key=("id",))))


def test_key_rate(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a")], "k int, v string")
    assert tuple(quality.key_unique_rate(df, ["k"]).first()) == (4, 3, 0.75)
    assert tuple(quality.key_unique_rate(df.where("false"), ["k"]).first()) == (0, 0, 1.0)


def test_null_metric_is_not_sane_but_passes_the_gate(spark):
    df = spark.createDataFrame([(0.5, 1.0), (None, -1.0), (2.0, 0.0)], "ctr double, roi double")
    got = {r.metric: (r.ok_rows, r.total_rows, r.ok_rate) for r in quality.metric_sanity(df).collect()}
    assert got == {"ctr": (1, 3, 0.33333), "roi": (2, 3, 0.66667)}
    assert found(quality.check_table(df, TableChecks("x", "t", rates=("ctr",)))) == {"ctr in [0,1]": 1}


def test_logic(spark):
    df = spark.createDataFrame([(1, 2, 3, -1.0), (5, 2, 1, 0.0)], "impressions int, clicks int, conversions int, cost double")
    got = {r.rule: r.bad_rows for r in quality.logic_violations(df).collect()}
    assert got == {"clicks > impressions": 1, "conversions > clicks": 1, "cost < 0": 1}


def test_missing_tables_are_an_error(spark):
    with pytest.raises(ValueError, match="ad_cost"):
        quality.dq_report({"ods.ad_event_log": spark.createDataFrame([], "dt string")})
