import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import joins, panel


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture
def series(spark):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 4, 7])], "t int, x double")


def test_transform_diffs_then_lags(series):
    got = rows(panel.transform(series, ["x"], ["t"], diff=1, lag=1).select("t", "L_D_x"), "t")
    assert got == [(0, None), (1, None), (2, 1.0), (3, 2.0)]
    again = panel.transform(panel.transform(series, ["x"], ["t"], lag=1), ["x"], ["t"], lag=1)
    assert again.columns.count("L_x") == 1


def test_lags_leads_and_no_lag_of_zero(series):
    got = rows(panel.add_lags(series, "x", [1, -2], ["t"]).select("t", "L1_x", "F2_x"), "t")
    assert got == [(0, None, 4.0), (1, 1.0, 7.0), (2, 2.0, None), (3, 4.0, None)]
    with pytest.raises(ValueError):
        panel.add_lags(series, "x", [0], ["t"])


def test_calendar_lag_does_not_jump_a_gap(spark):
    df = spark.createDataFrame([(day("2020-01-01"), 1.0), (day("2020-02-01"), 2.0), (day("2020-04-01"), 4.0)], "d date, x double")
    got = rows(panel.calendar_lags(df, "x", "d", [1], "month").select("d", "L1_x"), "d")
    assert [x for _, x in got] == [None, 1.0, None]
    assert [x for _, x in rows(panel.to_panel(df, [], "d", "month"), "d")] == [1.0, 2.0, None, 4.0]


def test_resample_keeps_empty_periods(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 3), 1.0), (dt.datetime(2020, 1, 9), None), (dt.datetime(2020, 3, 1), 5.0)], "t timestamp, x double")
    got = rows(panel.resample(df, "t", "month", {"sum": ["x"], "last": ["x"], "mean": ["x"]}), "t")
    assert got == [(day("2020-01-01"), 1.0, 1.0, 1.0), (day("2020-02-01"), 0.0, None, None), (day("2020-03-01"), 5.0, 5.0, 5.0)]


def test_quarter_strings(spark):
    df = spark.createDataFrame([("2020Q1",), ("2020Q4",), ("2021Q2",)], "s string")
    got = [d for (d,) in rows(df.select(panel.quarter_of_string(F.col("s")).alias("d")), "d")]
    assert got == [day("2020-01-01"), day("2020-10-01"), day("2021-04-01")]


def test_merge_of_dates_is_outer(spark):
    a = spark.createDataFrame([(day("2020-01-01"), 1.0), (day("2020-04-01"), 2.0)], "date date, a double")
    b = spark.createDataFrame([(day("2020-04-01"), 3.0), (day("2020-07-01"), 4.0)], "date date, b double")
    got = rows(joins.merge_date_many([a, b]), "date")
    assert [r[1:] for r in got] == [(1.0, None), (2.0, 3.0), (None, 4.0)]
    assert joins.load_outer({"T": b.withColumn("c", F.col("b"))}).columns == ["date", "T_b", "T_c"]


def test_forecasts_of_a_line_are_exact(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 + 3 * i) for i in range(1, 16)], "t int, x double, y double")
    got = rows(panel.rolling_forecast(df, "y", "x", ["t"], 5).select("t", "y", "forecast"), "t")
    assert all(f is None for _, _, f in got[:5]) and all(f == pytest.approx(y) for _, y, f in got[5:])


def test_rolling_sum_waits_for_its_window(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 4.0)], "t int, x double")
    got = rows(df.select("t", panel.rolling_full(F.col("x"), 2, Window.orderBy("t")).alias("s")), "t")
    assert [s for _, s in got] == [None, None, None, 7.0]


def test_interpolation_holds_the_last_value(spark):
    dates = [day(f"2020-0{m}-01") for m in range(1, 6)]
    df = spark.createDataFrame(list(zip(["g"] * 5, dates, [None, 1.0, None, 3.0, None], strict=True)), "g string, d date, x double")
    got = [x for (x,) in rows(panel.interpolate_linear(df, "x", "d", ["g"]).orderBy("d").select("x_filled"))]
    assert got[0] is None and got[1] == 1.0 and 1 < got[2] < 3 and got[3:] == [3.0, 3.0]


def test_allocation_keeps_the_total(spark):
    df = spark.createDataFrame([(day("2020-01-31"), 31.0), (day("2020-03-01"), 5.0), (day("2020-05-01"), 0.0)], "d date, v double")
    got = rows(panel.allocate_to_months(df, "d", "v"), "month")
    assert [round(x, 9) for _, x in got] == [1.0, 30.0, 5.0, 0.0, 0.0]


@pytest.mark.parametrize(("treated", "others", "caliper", "want"), [([0.5], [0.2, 0.45, 0.9], 0.0, [(0, 1)]), ([0.9], [0.3], 0.1, []), ([0.3, 0.5], [0.1, 0.4, 0.8], 0.0, [(0, 1), (1, 1)])])
def test_nearest_match(spark, treated, others, caliper, want):
    t = spark.createDataFrame(list(enumerate(treated)), "t long, s double")
    u = spark.createDataFrame(list(enumerate(others)), "u long, s double")
    assert [r[:2] for r in rows(joins.nearest_match(t, u, "t", "u", "s", caliper), "treated")] == want


def test_nearest_match_equals_all_pairs(spark):
    import random

    random.seed(4)
    t = [(i, random.randrange(200) / 7) for i in range(120)]
    u = [(i, random.randrange(200) / 7) for i in range(90)]
    got = rows(joins.nearest_match(spark.createDataFrame(t, "t long, s double"), spark.createDataFrame(u, "u long, s double"), "t", "u", "s"), "treated")
    for i, j, d in got:
        best = min((abs(dict(t)[i] - s), k) for k, s in u)
        assert (pytest.approx(d), j) == (best[0], best[1])
    assert len(got) == 120


def test_interval_mask_keeps_rows(spark):
    a = spark.createDataFrame([(1, day("2020-01-01")), (1, day("2021-01-01"))], "k int, d date")
    b = spark.createDataFrame([(1, day("2019-06-01"), day("2020-06-01"), 7.0)], "k int, a date, b date, v double")
    got = rows(joins.interval_mask(a, b, ["k"], "d", "a", "b", ["v"]).select("d", "v"), "d")
    assert [v for _, v in got] == [7.0, None]
