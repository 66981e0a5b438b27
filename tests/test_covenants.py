import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import covenants

D = lambda m, d=1: datetime.date(2020, m, d)


def test_limits_of_packages_bind(spark):
    df = spark.createDataFrame([(1, "Min. a", 2.0), (1, "Min. a", 1.0), (1, "Max. b", 3.0), (1, "Max. b", 5.0), (2, "c", 1.0), (2, "c", 2.0), (2, "c", None)], "package long, kind string, value double")
    assert rows(covenants.package_limits(df), "package", "kind") == [(1, "Max. b", 5.0, 2), (1, "Min. a", 1.0, 2), (2, "c", 1.5, 3)]


def test_year_to_date_becomes_quarters(spark):
    df = spark.createDataFrame([("a", 2020, q, v) for q, v in ((1, 5.0), (2, 7.0), (4, 20.0))] + [("a", 2021, 2, 3.0), ("a", 2021, 3, None), ("b", 2020, 1, 1.0)], "k string, y int, q int, v double")
    assert rows(covenants.quarterly_flows(df, ["k"], "y", "q", ["v"]), "k", "y", "q") == [
        ("a", 2020, 1, 5.0), ("a", 2020, 2, 2.0), ("a", 2020, 4, None), ("a", 2021, 2, None), ("a", 2021, 3, None), ("b", 2020, 1, 1.0),
    ]


def test_lines_between_known_values(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate([None, 2.0, None, None, 8.0, None])] + [("b", 0, None)], "k string, t int, v double")
    assert [v for *_, v in rows(covenants.filled_between(df, ["k"], "t", ["v"]), "k", "t")] == [None, 2.0, 4.0, 6.0, 8.0, 8.0, None]


def test_the_chain_keeps_dates_without_limits(spark):
    reports = spark.createDataFrame([("x", D(3), 4.0), ("x", D(9), 1.0), ("y", D(3), -1.0), ("z", D(3), 0.0)], "company string, date date, earned double")
    contracts = spark.createDataFrame([(1, "Min. e", 2.0), (1, "Min. e", 3.0), (2, "Min. e", 1.5), (3, "Max. f", 9.0), (4, "Min. e", 1.0)], "package long, kind string, value double")
    facilities = spark.createDataFrame([(1, D(1), D(4)), (1, D(2), D(6)), (2, D(1), D(12)), (3, D(1), D(12)), (4, D(1), D(12)), (5, None, None)], "package long, start date, end date")
    links = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (3, "x"), (4, "y")], "package long, company string")
    got = covenants.covenant_distances(reports, contracts, facilities, links, {"Min. e": F.col("earned")})
    assert rows(got, "company", "date", "kind") == [
        ("x", D(3), "Max. f", 9.0, 1, None, None, True),
        ("x", D(3), "Min. e", 1.5, 3, 4.0, 2.5, True),
        ("x", D(9), "Max. f", 9.0, 1, None, None, True),
        ("x", D(9), "Min. e", 1.5, 1, 1.0, -0.5, True),
        ("y", D(3), "Min. e", 1.0, 1, -1.0, -2.0, False),
    ]
    assert {r["company"] for r in covenants.sound_companies(got).collect()} == {"x"}
    late = covenants.active_limits(reports, spark.createDataFrame([("z", "Min. e", 1.0, 1, D(5), D(6))], "company string, kind string, limit double, n long, start date, end date"))
    assert rows(late) == [("z", D(3), "Min. e", None, 0)]


def test_headroom_of_zero(spark):
    df = spark.createDataFrame([("Min. a", 3.0, 0.0), ("Min. a", 3.0, 2.0), ("Max. b", 0.0, 2.0), ("Max. b", 4.0, 2.0)], "k string, v double, l double")
    assert [r[0] for r in rows(df.select(covenants.headroom(F.col("k"), F.col("v"), F.col("l"))))] == pytest.approx([666.0, 1.5, 666.0, 0.5])
