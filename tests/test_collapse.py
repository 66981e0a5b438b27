import math

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import bins, collapse, quantiles


@pytest.fixture
def small(spark):
    return spark.createDataFrame([(1.0, "a", 1.0), (3.0, "a", 1.0), (7.0, "b", 1.0), (9.0, "b", 1.0)], "x double, g string, w double")


def test_collapser_means_sums_and_coarser_groups(small):
    made = collapse.Collapser.of(small, ["x"], ["g"], "w")
    assert rows(made.means(with_denominators=True), "g") == [("a", 2.0, 2.0), ("b", 8.0, 2.0)]
    assert rows(made.sums(), "g") == [("a", 4.0), ("b", 16.0)]
    assert rows(made.collapse([]).means()) == [(5.0,)]
    with pytest.raises(ValueError):
        made.collapse(["h"])


def test_concat_equals_the_whole_and_checks_kinds(small):
    halves = [collapse.Collapser.of(small.where(c), ["x"], ["g"], "w") for c in ("x < 5", "x > 2")]
    whole = collapse.Collapser.of(small.unionByName(small.where("x = 3")), ["x"], ["g"], "w")
    assert rows(collapse.concat(halves).means(), "g") == rows(whole.means(), "g")
    with pytest.raises(ValueError):
        collapse.concat([halves[0], collapse.Collapser.of(small, ["x"], ["g"])])


def test_the_two_denominators(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", None, 3.0), (None, 5.0, 1.0)], "g string, x double, w double")
    assert rows(collapse.collapse(df, ["g"], ["x"], "w")) == [("a", 2.0)]
    assert rows(collapse.collapse_all_weights(df, ["g"], ["x"], "w")) == [("a", 0.5)]


def test_empty_group_and_missing_sum(spark):
    df = spark.createDataFrame([("a", None, 1.0)], "g string, x double, w double")
    assert rows(collapse.collapse(df, ["g"], ["x"], "w")) == [("a", None)]
    assert rows(collapse.collapse(df, ["g"], ["x"], "w", as_sum=True)) == [("a", 0.0)]
    assert rows(collapse.collapse(df.where("false"), ["g"], ["x"], "w")) == []


def test_safe_sum(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 1.0), ("b", None)], "g string, x double")
    assert rows(df.groupBy("g").agg(collapse.safe_sum("x").alias("s")), "g") == [("a", 6.0), ("b", None)]


def weighted_quantile(v, w, q):
    keep = np.isfinite(v) & (w > 0)
    v, w = v[keep], w[keep]
    o = np.lexsort((w, v))
    v, w = v[o], w[o]
    return float(np.interp(q, (np.cumsum(w) - 0.5 * w) / w.sum(), v)) if len(v) else None


@pytest.mark.parametrize(
    ("values", "weights", "q", "expected"),
    [([5.0, None, None], [1.0, 0.0, 0.0], 0.5, 5.0), ([None, None], [1.0, 1.0], 0.5, None), ([1.0, 999.0], [1.0, 0.0], 0.5, 1.0)],
)
def test_weighted_quantile_edges(spark, values, weights, q, expected):
    df = spark.createDataFrame(list(zip(values, weights, strict=True)), "x double, w double")
    got = rows(quantiles.weighted_quantiles(df, [], "x", "w", [q]))
    assert got == [(expected,)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(0, 4)), min_size=1, max_size=12), st.floats(0.01, 0.99))
def test_weighted_quantile_equals_interpolation(spark, data, q):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in data], "x double, w double")
    got = rows(quantiles.weighted_quantiles(df, [], "x", "w", [q]))[0][0]
    want = weighted_quantile(np.array([a for a, _ in data], float), np.array([b for _, b in data], float), q)
    assert (got is None and want is None) or math.isclose(got, want, abs_tol=1e-9)


def test_gini_of_two_points(spark):
    for values in ([1.0, 2.0], [1.0, 1.0, 2.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "income double")
        for f in (quantiles.gini_trapezoid, quantiles.gini_simpson):
            assert rows(f(df, "income"))[0][0] == pytest.approx(1 / 3)


def test_top_shares_fall_with_p(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(1, 101)], "id long, income double")
    got = dict(rows(quantiles.top_shares(df, "income", [0.01, 0.1, 0.5])))
    assert 0 < got[0.01] <= got[0.1] <= got[0.5] <= 1


def test_right_closed_histogram_leaves_the_first_edge_out(spark):
    df = spark.createDataFrame([(float(i), 2.0) for i in range(10)], "x double, w double")
    got = rows(bins.share_histogram(df, "x", [0, 3, 6, 10], "w"), "left")
    assert [round(s, 6) for _, s in got] == [round(3 / 9, 6)] * 3


def test_bins_of_both_kinds_and_clipping(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "x double")
    assert [b for _, b in rows(bins.bin_data(df, "x", 4), "x")] == [0, 0, 1, 1, 2, 2, 3, 3]
    assert [r[1:] for r in rows(bins.bin_dummies(df, "x", 2), "x")] == [(1, 0)] * 4 + [(0, 1)] * 4
    clipped = [x for (x,) in rows(bins.winsorize(df, ["x"], 0.5), "x")]
    assert min(clipped) == pytest.approx(2.75) and max(clipped) == pytest.approx(6.25)


def test_fixed_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (11.0,)], "x double")
    assert rows(bins.histogram(df, "x", 0, 10, 2), "bin") == [(0, 1), (1, 2)]


def test_resample_of_partials(spark):
    df = spark.sql("select date'2020-01-05' d, 1.0D x union all select date'2020-01-25', 3.0D union all select date'2020-03-01', 7.0D")
    made = collapse.Collapser.of(df, ["x"], ["d"]).resample("d", "month")
    assert [(str(d), x) for d, x in rows(made.means(), "d")] == [("2020-01-01", 2.0), ("2020-03-01", 7.0)]
    assert df.select(F.count(F.lit(1))).first()[0] == 3
