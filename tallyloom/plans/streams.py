"""Streaming queries over events, run for what there is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.aggregates import rounded
from tallyloom.plans.registry import Catalogue
from tallyloom.streaming import collapse

catalogue = Catalogue()
query = catalogue.query


def name() -> str:
    return "s" + uuid.uuid4().hex


@query("""SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, round(avg(value),6) AS value, count(*) AS n FROM events GROUP BY 1,2""")
def stream_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapse.read_stream(spark, sf_dir, "events")
    made = collapse.run_available(collapse.stream_collapse(rows, "ts", "1 day", ["event_type"], ["value"]), name())
    return rounded(made.select(F.col("start").cast("date").alias("day"), "event_type", "value", "n"), 6, "value")


@query("""SELECT CAST(d AS DATE) AS day, round(avg(value),6) AS value, count(*) AS n FROM
  (SELECT value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapse.read_stream(spark, sf_dir, "events")
    made = collapse.run_available(collapse.stream_collapse(rows, "ts", "2 days", [], ["value"], slide="1 day"), name())
    return rounded(made.select(F.col("start").cast("date").alias("day"), "value", "n"), 6, "value")


@query("""SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, round(sum(value), 4) AS value, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapse.read_stream(spark, sf_dir, "events")
    made = collapse.run_available(collapse.stream_resample(rows, "ts", "week", {"value": "sum", "event_id": "max"}, ["event_type"]), name())
    return rounded(made.select(F.col("start").cast("date").alias("week"), "event_type", "value", "event_id", "n"), 4, "value")


@query("SELECT user_id, count(*) AS n, round(regr_slope(value, event_id),6) AS slope FROM events GROUP BY 1")
def stream_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapse.read_stream(spark, sf_dir, "events")
    made = collapse.run_available(collapse.stream_regression(rows, "user_id", "event_id", "value"), name())
    return rounded(made, 6, "slope")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  c AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, count(DISTINCT k) AS sessions FROM c GROUP BY 1""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = rows.groupBy(F.session_window(F.col("ts").cast("timestamp"), "12 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return made.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
