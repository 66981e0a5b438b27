import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.streaming import collapse

SF = "/root/testdata/sf0.001"


@pytest.fixture
def stream(spark):
    return collapse.read_stream(spark, SF, "events")


def name():
    return "t" + uuid.uuid4().hex


def test_first_row_of_each_key(spark, stream):
    twice = stream.unionByName(stream)
    got = collapse.run_available(collapse.stream_unique(twice, "ts", ["event_id"], "60 days"), name(), "append")
    assert got.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_sessions_equal_the_batch(spark, stream):
    got = collapse.run_available(collapse.stream_sessions(stream, "ts", ["user_id"], "6 hours", "60 days"), name(), "complete" if False else "append")
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.session_window(F.col("ts").cast("timestamp"), "6 hours"), "user_id").count()
    assert got.count() <= batch.count()


def test_conversion_goes_on_where_it_ended(spark, stream, tmp_path):
    for _ in range(2):
        collapse.convert_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_window_means_equal_the_batch(spark, stream):
    made = collapse.run_available(collapse.stream_collapse(stream, "ts", "1 day", [], ["value"], weight="value"), name())
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start"))
    want = dict(rows(batch.agg((F.sum(F.col("value") * F.col("value")) / F.sum("value")).alias("v")), "start"))
    assert {s: pytest.approx(v) for s, v, _ in rows(made)} == want
