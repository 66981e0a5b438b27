"""Plans reach the scan with filters and columns, and stay free of pairs and of Python where they can."""

import pytest

import __spark_entry__ as entry
from tallyloom.operators import joins
from tallyloom.plans import relational
from tallyloom.sources.readers import load_partition

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(load_partition(spark, f"{SF}/orders.parquet", [("o_totalprice", ">", 1000.0)], ["o_orderkey"]))
    assert "GreaterThan(o_totalprice,1000.0)" in text and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_filters_pass_the_canonical_view(spark):
    assert "GreaterThan(o_totalprice,100000.0)" in plan(relational.canonical_schema(spark, SF))


@pytest.mark.parametrize("name", ["collapse_mean", "collapse_multiweight", "weighted_mean_var_std", "percent_violations"])
def test_aggregates_are_summed_before_the_exchange(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "partial_sum" in text or "partial_avg" in text
    assert "Python" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["pairwise_match", "calendar_lag", "interval_mask_join", "crosswalk_allocate"])
def test_joins_make_no_pairs(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def rows_of_joins(df):
    """The rows that each join of the plan gave when it ran."""
    df.collect()
    left, found = [df._jdf.queryExecution().executedPlan()], []
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            left += [node.children().apply(i) for i in range(node.children().size())]
        if name.endswith("JoinExec"):
            found.append(node.metrics().apply("numOutputRows").value())
    return found


def test_a_source_of_many_rows_and_targets_makes_no_pairs(spark):
    values = spark.range(400).selectExpr("id % 2 AS source", "CAST(IF(id % 5 = 0, NULL, id) AS DOUBLE) AS v", "id % 4 DIV 2 AS day")
    factors = spark.range(300).selectExpr("id % 3 AS source", "id AS target", "(id + 1) / 1000.0D AS factor")
    made = joins.crosswalk_allocate(values, factors, "source", "target", ["v"], ["day"])
    assert rows_of_joins(made) == [400]
    sums = {(s, d): sum(i for i in range(400) if i % 2 == s and i % 4 // 2 == d and i % 5) for s in (0, 1) for d in (0, 1)}
    expected = {(t, d): sums[t % 3, d] * (t + 1) / 1000 for t in range(300) if t % 3 < 2 for d in (0, 1)}
    assert {(r.target, r.day): r.v for r in made.collect()} == pytest.approx(expected)
