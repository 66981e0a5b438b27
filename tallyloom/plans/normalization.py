"""Queries of single kinds of normalisation, over columns put into untidy forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.registry import Catalogue
from tallyloom.plans.session import table
from tallyloom.sources import contracts

catalogue = Catalogue()
query = catalogue.query


def untidy(spark: SparkSession, sf_dir: str, *forms: Column) -> DataFrame:
    """(event_id, x): events in one of three forms, by event_id."""
    form = F.when(F.col("event_id") % 3 == 0, forms[0]).when(F.col("event_id") % 3 == 1, forms[1]).otherwise(forms[2])
    return table(spark, sf_dir, "events").select("event_id", form.alias("x"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN upper(event_type) END AS x FROM events")
def normalize_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = untidy(spark, sf_dir, F.concat(F.lit(" \t"), kind, F.lit(" \n")), F.lit("   "), kind)
    return rows.select("event_id", contracts.string_value(F.col("x"), upper=True).alias("x"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN CAST(user_id AS BIGINT) END AS x FROM events")
def normalize_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    return contracts.normalize_dataframe(untidy(spark, sf_dir, F.concat(user, F.lit(".0")), F.lit(" "), user), integer=["x"])


@query("SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN CAST(user_id AS DOUBLE) / 4 END AS x FROM events")
def normalize_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = (F.col("user_id") / 4).cast("string")
    return contracts.normalize_dataframe(untidy(spark, sf_dir, F.concat(F.lit(" "), quarter), F.lit(""), quarter), numeric=["x"], nonnegative=["x"])


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id % 2 = 0 WHEN 2 THEN user_id % 2 = 1 END AS x FROM events")
def normalize_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("user_id") % 2 == 0
    rows = untidy(spark, sf_dir, F.when(even, " TRUE").otherwise("false "), F.lit(None).cast("string"), F.when(even, "0.0").otherwise("1.00"))
    return contracts.normalize_dataframe(rows, binary=["x"])


@query("SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS x FROM events")
def normalize_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    made = contracts.normalize_dataframe(untidy(spark, sf_dir, day, F.lit(None).cast("string"), F.concat(day, F.lit(" 00:00:00"))), datetime=["x"])
    return made.select("event_id", F.col("x").cast("timestamp_ntz").alias("x"))


@query("""WITH d AS (SELECT l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_tax AS DOUBLE) END AS a, CASE WHEN l_orderkey % 3 > 0 THEN CAST(l_discount AS DOUBLE) END AS b FROM lineitem)
  SELECT l_suppkey, CAST(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS "whole", CAST(count(*) FILTER (a IS NOT NULL OR b IS NOT NULL) AS BIGINT) AS some FROM d GROUP BY 1""")
def dropna_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax").cast("double")).otherwise(F.when(F.col("l_linenumber") % 3 == 0, float("nan"))).alias("a"),
        F.when(F.col("l_orderkey") % 3 > 0, F.col("l_discount").cast("double")).otherwise(float("inf")).alias("b"),
    )
    kinds = dict(rows.dtypes)
    masks = {"whole": contracts.complete(["a", "b"], kinds), "some": contracts.complete(["a", "b"], kinds, "all")}
    return rows.groupBy("l_suppkey").agg(*(F.count_if(m).alias(n) for n, m in masks.items()))
