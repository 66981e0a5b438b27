"""Queries over the driver's tables put into publishers' forms and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.aggregates import rounded
from tallyloom.plans.registry import Catalogue
from tallyloom.plans.session import shared_folder, table
from tallyloom.sources import loan_archives, publishers

catalogue = Catalogue()
query = catalogue.query

MONTHS = ["1995-01", "1995-02", "1995-03"]


@query(f"""WITH o AS (SELECT c_nationkey AS n, strftime(o_orderdate, '%Y-%m') AS m, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
  grid AS (SELECT n, m FROM (SELECT DISTINCT n FROM o) CROSS JOIN (SELECT unnest({MONTHS}) AS m))
  SELECT lpad(CAST(g.n AS VARCHAR), 2, '0') || '007' AS fips, last_day(CAST(g.m || '-01' AS DATE)) AS date, g.n AS region_id, round(sum(v), 3) AS zhvi
  FROM grid g LEFT JOIN o ON o.n = g.n AND o.m = g.m GROUP BY g.n, g.m""")
def housing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_nationkey").alias("RegionID"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    wide = rows.groupBy("RegionID").pivot("month", MONTHS).agg(F.sum("o_totalprice"))
    wide = wide.withColumns({"StateCodeFIPS": F.concat(F.col("RegionID").cast("string"), F.lit(".0")), "MunicipalCodeFIPS": F.lit("7")})
    return rounded(publishers.housing_values(wide), 3, "zhvi")


@query("""SELECT CAST(o_custkey % 900 + 100 AS INTEGER) AS zip3, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(quarter(o_orderdate) AS INTEGER) AS quarter, round(avg(o_totalprice), 6) AS hpi FROM orders GROUP BY 1, 2, 3, 4""")
def house_price_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [(F.col("o_custkey") % 900 + 100).alias("a"), F.year("o_orderdate").alias("b"), F.quarter("o_orderdate").alias("c")]
    raw = table(spark, sf_dir, "orders").groupBy(*keys).agg(F.avg("o_totalprice").alias("d")).withColumn("e", F.lit("Native"))
    titles = spark.createDataFrame([("A title", None, None, None, None), ("Code", "Year", "Quarter", "Index", "Type")], "a string, b string, c string, d string, e string")
    return rounded(publishers.price_index(titles.union(raw.select(*(F.col(c).cast("string") for c in raw.columns))), "zip3", "quarter"), 6, "hpi")


@query("""SELECT 10000 + CAST(c_nationkey AS BIGINT) AS zip, DATE '2014-01-01' AS date, CAST(sum(c_custkey % 3) AS DOUBLE) AS n_returns, round(sum(c_acctbal), 3) AS agi
  FROM customer WHERE c_custkey % 3 >= 1 AND c_nationkey > 0 GROUP BY 1""")
def tax_by_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey")
    raw = table(spark, sf_dir, "customer").select(
        F.when(k > 0, k + 10000).otherwise(F.lit(0)).alias("ZIPCODE"), (F.col("c_custkey") % 6 + 1).alias("AGI_STUB"), (F.col("c_custkey") % 3).alias("N1"), F.col("c_acctbal").alias("A00100")
    )
    return rounded(publishers.tax_statistics(raw, "zip", 2014), 3, "agi")


LOAN = "CAST(floor(o_totalprice / 1000) AS BIGINT)"


@query(f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS asof_date, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS respondent_id, {LOAN} AS loan_amt,
  CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey % 1000 AS DOUBLE) END AS app_income FROM orders""")
def loan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {
        "asof_date": F.year("o_orderdate"), "respondent_id": F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), "loan_amt": F.floor(F.col("o_totalprice") / 1000),
        "app_income": F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_custkey") % 1000).cast("string")).otherwise("NA"),
    }
    fields = [F.lpad(values.get(name, F.lit("")).cast("string"), width, " ") for name, width, _ in publishers.LOAN_FIELDS]
    lines = table(spark, sf_dir, "orders").select(F.concat(*fields).alias("value"))
    return lines.select(*publishers.loan_columns(F.col("value"))).select("asof_date", "respondent_id", "loan_amt", "app_income")


@query(f"""SELECT CAST(year(o_orderdate) AS BIGINT) AS activity_year, {LOAN} AS loan_amount_000s, CASE WHEN year(o_orderdate) < 1995 THEN CAST(o_custkey AS DOUBLE) END AS applicant_income_000s,
  CAST(NULL AS VARCHAR) AS lei, CASE WHEN year(o_orderdate) < 1995 THEN '1994' ELSE '1995' END AS source_year, CASE WHEN year(o_orderdate) < 1995 THEN 'old' ELSE 'new' END AS source
  FROM orders WHERE {LOAN} >= 100""")
def canonical_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["activity_year", "loan_amount_000s", "applicant_income_000s", "lei"]
    year, amount = F.year("o_orderdate"), F.floor(F.col("o_totalprice") / 1000)
    rows = table(spark, sf_dir, "orders")
    old = rows.where(year < 1995).select(year.alias("asof_date"), amount.alias("loan_amt"), F.col("o_custkey").alias("app_income"))
    new = rows.where(year >= 1995).select(year.alias("as_of_year"), amount.alias("Loan Amount 000s"))
    parts = [publishers.canonical_loans(old, 1994, "old", columns), publishers.canonical_loans(new, 1995, "new", columns)]
    return reduce(DataFrame.unionByName, parts).where("loan_amount_000s >= 100")


@query(f"""SELECT CAST(year(o_orderdate) AS BIGINT) AS activity_year, {LOAN} AS loan_amount_000s, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey % 1000 AS DOUBLE) END AS applicant_income_000s,
  CAST(o_custkey % 7 AS BIGINT) AS applicant_race_1, CAST(o_orderkey % 10000000 AS VARCHAR) AS sequence_number, '2010' AS source_year, 'nara' AS source FROM orders WHERE {LOAN} >= 200""")
def loan_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as fixed-width records of a year, converted once and loaded under canonical names."""
    values = {
        "asof_date": F.year("o_orderdate"), "loan_amt": F.floor(F.col("o_totalprice") / 1000), "app_race_1": F.col("o_custkey") % 7, "seq_num": F.col("o_orderkey") % 10000000,
        "app_income": F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_custkey") % 1000).cast("string")).otherwise("NA"),
    }
    fields = [F.lpad(values.get(name, F.lit("")).cast("string"), width, " ") for name, width in loan_archives.LATER_FIELDS]
    root = f"{shared_folder(spark)}/loans-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").select(F.concat(*fields).alias("value")).write.text(f"{root}/raw/nara/2010/records")
    columns = ["activity_year", "loan_amount_000s", "applicant_income_000s", "applicant_race_1", "sequence_number"]
    return loan_archives.LoanArchive(spark, root).load(2010, "nara", columns, F.col("loan_amount_000s") >= 200, canonical=True, convert=True)


@query("""SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, round(sum(o_totalprice), 3) AS hh_total_assets_level, CAST(count(*) AS DOUBLE) AS nfc_loans_flow
  FROM orders GROUP BY 1""")
def flow_of_funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = F.concat(F.year("o_orderdate").cast("string"), F.lit(":Q"), F.quarter("o_orderdate").cast("string"))
    raw = table(spark, sf_dir, "orders").groupBy(quarter.alias("date")).agg(F.round(F.sum("o_totalprice"), 3).alias("FL15.Q"), F.count(F.lit(1)).alias("FA10.Q"))
    words = spark.createDataFrame([("FL15.Q", "Households; total assets"), ("FA10.Q", " Nonfinancial corporate business; loans"), ("FL99.Q", "not in the table")], "code string, name string")
    return publishers.flow_table(raw, words, kinds=True)


@query("""WITH q AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, round(sum(o_totalprice), 3) AS a, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)
  SELECT date, a AS assets, n AS gross_income FROM q""")
def flow_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The household set from two tables that have one of its series each."""
    quarter = F.concat(F.year("o_orderdate").cast("string"), F.lit(":Q"), F.quarter("o_orderdate").cast("string"))
    sums = table(spark, sf_dir, "orders").groupBy(quarter.alias("date")).agg(F.round(F.sum("o_totalprice"), 3).alias("a"), F.count(F.lit(1)).alias("n"))
    tables = {"b101": sums.select("date", F.col("a").alias("FL152000005.Q"), F.lit("ND").alias("other.Q")), "f101": sums.select("date", F.col("n").alias("FA156010001.Q"))}
    return publishers.flow_set(tables.get, publishers.FLOW_SETS["household"])[0]
