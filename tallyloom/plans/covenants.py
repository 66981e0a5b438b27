"""Queries of the covenant chain: customers as firms, their orders as loan packages and as what they report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import covenants
from tallyloom.operators.joins import percent_violations
from tallyloom.plans.registry import Catalogue
from tallyloom.plans.session import table

catalogue = Catalogue()
query = catalogue.query

#: A quarter's orders of a customer, summed from the year's start.
REPORTS = """SELECT c, y, q, d, n, sum(total) OVER (PARTITION BY c, y ORDER BY q) AS ytd FROM (SELECT o_custkey AS c, year(o_orderdate) AS y, quarter(o_orderdate) AS q,
  CAST(last_day(date_trunc('quarter', any_value(o_orderdate)) + INTERVAL 2 MONTH) AS DATE) AS d, count(*) AS n, sum(CAST(o_totalprice AS DOUBLE)) AS total FROM orders GROUP BY 1, 2, 3)"""
FLOWS = f"""SELECT c, d, n, CASE WHEN q = 1 THEN ytd WHEN lag(q) OVER w = q - 1 THEN ytd - lag(ytd) OVER w END AS flow FROM ({REPORTS}) WINDOW w AS (PARTITION BY c, y ORDER BY q)"""
KIND = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Max. sales' WHEN o_orderpriority = '2-HIGH' THEN 'Min. sales' WHEN o_orderpriority = '3-MEDIUM' THEN 'Min. price' ELSE 'Other' END"
DISTANCES = f"""f AS ({FLOWS}), l AS (SELECT o_custkey AS c, {KIND} AS kind, o_orderdate AS s, o_orderdate + INTERVAL 730 DAY AS e, CAST(o_totalprice AS DOUBLE) AS v FROM orders),
  a AS (SELECT f.c, f.d, kind, CASE WHEN kind LIKE 'Min%' THEN min(v) FILTER (d BETWEEN s AND e) WHEN kind LIKE 'Max%' THEN max(v) FILTER (d BETWEEN s AND e)
    ELSE avg(v) FILTER (d BETWEEN s AND e) END AS lim, count(*) FILTER (d BETWEEN s AND e) AS n FROM f JOIN l USING (c) GROUP BY 1, 2, 3),
  m AS (SELECT a.*, CASE WHEN kind = 'Min. price' THEN flow / f.n WHEN kind <> 'Other' THEN 4 * flow END AS value FROM a JOIN f USING (c, d)),
  x AS (SELECT *, CASE WHEN kind LIKE 'Min%' THEN value - lim WHEN kind LIKE 'Max%' THEN lim - value END AS distance FROM m)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("double"))
    day = F.last_day(F.add_months(F.trunc(F.first("o_orderdate"), "quarter"), 2))
    quarters = orders.groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
    quarters = quarters.agg(day.alias("date"), F.count(F.lit(1)).alias("orders"), F.sum("price").alias("sales"))
    running = quarters.withColumn("sales", F.sum("sales").over(Window.partitionBy("company", "year").orderBy("quarter")))
    reports = covenants.annualised(covenants.quarterly_flows(running, ["company"], "year", "quarter", ["sales"]), ["sales"])
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Max. sales")
        .when(F.col("o_orderpriority") == "2-HIGH", "Min. sales")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Min. price")
        .otherwise("Other")
    )
    contracts = orders.select(F.col("o_orderkey").alias("package"), kind.alias("kind"), F.col("price").alias("value"))
    facilities = orders.select(F.col("o_orderkey").alias("package"), F.col("o_orderdate").cast("date").alias("start"), F.date_add(F.col("o_orderdate").cast("date"), 730).alias("end"))
    links = orders.select(F.col("o_orderkey").alias("package"), F.col("o_custkey").alias("company"))
    measures = {"Max. sales": F.col("sales_ann"), "Min. sales": F.col("sales_ann"), "Min. price": F.col("sales") / F.col("orders")}
    return covenants.covenant_distances(reports, contracts, facilities, links, measures)


@query(f"""WITH {DISTANCES} SELECT c AS company, d AS date, kind, round(lim, 6) AS "limit", CAST(n AS BIGINT) AS n, round(value, 6) AS value, round(distance, 6) + 0.0 AS distance FROM x""")
def covenant_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chain(spark, sf_dir)
    return made.select("company", "date", "kind", F.round("limit", 6).alias("limit"), "n", F.round("value", 6).alias("value"), (F.round("distance", 6) + 0.0).alias("distance"))


@query(f"""WITH {DISTANCES} SELECT kind, round(sum((round(distance, 6) < 0)::INT) / nullif(count(distance)::DOUBLE, 0), 8) AS violated, count(distance) AS known, count(*) AS "dates" FROM x GROUP BY kind""")
def covenant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = covenants.sound_companies(chain(spark, sf_dir))
    return made.groupBy("kind").agg(F.round(percent_violations(F.round("distance", 6)), 8).alias("violated"), F.count("distance").alias("known"), F.count(F.lit(1)).alias("dates"))
