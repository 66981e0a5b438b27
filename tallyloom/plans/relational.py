"""Join, reshape, contract and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import joins, reshape
from tallyloom.operators.panel import period_start
from tallyloom.plans.aggregates import rounded
from tallyloom.plans.registry import Catalogue
from tallyloom.plans.session import table
from tallyloom.sources import contracts

catalogue = Catalogue()
query = catalogue.query


def match_sql(caliper: float = 0) -> str:
    return f"""WITH t AS (SELECT c_custkey AS t, c_acctbal AS s FROM customer WHERE c_mktsegment = 'BUILDING'),
      u AS (SELECT c_custkey AS u, c_acctbal AS s FROM customer WHERE c_mktsegment = 'MACHINERY'),
      m AS (SELECT t.t AS treated, arg_min(u.u, {{'d': abs(t.s-u.s), 'u': u.u}}) AS untreated, min(abs(t.s-u.s)) AS d FROM t, u GROUP BY 1)
      SELECT treated, untreated, round(d,6) AS dist FROM m {f"WHERE d <= {caliper}" if caliper else ""}"""


def matched(spark: SparkSession, sf_dir: str, caliper: float = 0.0) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("s"))
    treated, others = (customers.where(F.col("c_mktsegment") == v) for v in ("BUILDING", "MACHINERY"))
    return rounded(joins.nearest_match(treated, others, "c_custkey", "c_custkey", "s", caliper), 6, "dist")


@query(match_sql())
def pairwise_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir)


@query(match_sql(5))
def pairwise_match_caliper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir, 5.0)


FACTORS = """(SELECT s_nationkey, s_suppkey, s_acctbal/sum(s_acctbal) OVER (PARTITION BY s_nationkey) AS factor FROM supplier WHERE s_acctbal > 0)"""


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.crosswalk_factors(table(spark, sf_dir, "supplier").where("s_acctbal > 0"), "s_nationkey", "s_suppkey", "s_acctbal")


@query(f"SELECT s_nationkey, s_suppkey, round(factor,8) AS factor FROM {FACTORS}")
def crosswalk_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(factors(spark, sf_dir), 8, "factor")


@query(f"""SELECT s_suppkey, round(sum(c_acctbal*factor),4) AS c_acctbal FROM customer JOIN {FACTORS} ON c_nationkey = s_nationkey GROUP BY 1""")
def crosswalk_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "s_nationkey")
    return rounded(joins.crosswalk_allocate(rows, factors(spark, sf_dir), "s_nationkey", "s_suppkey", ["c_acctbal"]), 4, "c_acctbal")


@query("""WITH s AS (SELECT l_orderkey AS k, min(l_shipdate) AS a, max(l_shipdate) AS b, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
  SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 40 DAY BETWEEN a AND b THEN round(q,4) END AS q FROM orders JOIN s ON k = o_orderkey""")
def interval_mask_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    spans = spans.agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"), F.round(F.sum("l_quantity"), 4).alias("q"))
    rows = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate") + F.expr("interval 40 days"))
    return joins.interval_mask(rows, spans, ["o_orderkey"], "at", "a", "b", ["q"]).select("o_orderkey", "q")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, min(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE m >= 20000")
def group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.keep_groups(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_totalprice") >= 20000).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 666.0 ELSE l_tax/l_discount END,6) AS ratio FROM lineitem")
def ratio_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = joins.ratio(F.col("l_tax"), F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(made, 6).alias("ratio"))


@query("""SELECT o_orderpriority, round(avg(CASE WHEN d IS NOT NULL THEN CAST(d < 0 AS DOUBLE) END),6) AS share
  FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice - 150000 END AS d FROM orders) GROUP BY 1""")
def percent_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") - 150000)
    made = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(joins.percent_violations(d).alias("share"))
    return rounded(made, 6, "share")


@query("""SELECT p_partkey, 'p_size' AS series, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def unpivot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return reshape.to_long(rows, ["p_partkey"], ["p_size", "p_retailprice"])


@query("""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(CASE WHEN o_orderstatus='F' THEN o_totalprice END),3) AS F,
  round(sum(CASE WHEN o_orderstatus='O' THEN o_totalprice END),3) AS O, round(sum(CASE WHEN o_orderstatus='P' THEN o_totalprice END),3) AS P FROM orders GROUP BY 1""")
def pivot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(period_start(F.col("o_orderdate"), "month").alias("month"), "o_orderstatus")
    rows = rows.agg(F.round(F.sum("o_totalprice"), 3).alias("total"))
    return reshape.to_wide(rows, ["month"], "o_orderstatus", "total", ["F", "O", "P"])


@query("SELECT p_partkey, " + ", ".join(f"CAST(p_brand = 'Brand#{i}' AS INTEGER) AS p_brand_Brand{i}" for i in (11, 12, 13)) + " FROM part")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = [f"Brand#{i}" for i in (11, 12, 13)]
    return reshape.one_hot(table(spark, sf_dir, "part"), "p_brand", levels).select("p_partkey", *(f"p_brand_Brand{i}" for i in (11, 12, 13)))


@query("""SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment, NULL::BIGINT AS supplier FROM customer
  UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL, s_suppkey FROM supplier""")
def union_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").selectExpr("c_name name", "c_nationkey nation", "c_acctbal balance", "c_mktsegment segment")
    b = table(spark, sf_dir, "supplier").selectExpr("s_name name", "s_nationkey nation", "s_acctbal balance", "s_suppkey supplier")
    return reshape.union_schemas([a, b])


@query("""SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'old' ELSE 'new' END AS part FROM orders""")
def splice_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    old, new = rows.withColumn("part", F.lit("old")), rows.withColumn("part", F.lit("new"))
    return reshape.splice(old, new, "o_orderdate", F.lit("1995-01-01").cast("timestamp_ntz")).select("o_orderkey", "part")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a, region b")
def combine_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region")
    return reshape.combine_grids(rows.select(F.col("r_name").alias("a")), rows.select(F.col("r_name").alias("b")))


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*) > 1")
def require_unique_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) > 1 AS duplicate FROM lineitem")
def duplicate_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = contracts.duplicate_mask(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"], "first", ["l_linenumber"])
    return made.select("l_orderkey", "l_linenumber", "duplicate")


RAW = """(SELECT event_id, '  ' || event_type || ' ' AS s, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) || '.0' END AS i,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) || '.25' END AS x, CASE WHEN event_id % 4 = 0 THEN ' TRUE ' WHEN event_id % 4 = 1 THEN '0.0' WHEN event_id % 4 = 2 THEN '1' END AS b,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events)"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e,
        F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("s"),
        F.when(e % 5 != 0, F.concat(F.col("user_id").cast("string"), F.lit(".0"))).alias("i"),
        F.when(e % 3 == 0, "").otherwise(F.concat(e.cast("string"), F.lit(".25"))).alias("x"),
        F.when(e % 4 == 0, " TRUE ").when(e % 4 == 1, "0.0").when(e % 4 == 2, "1").alias("b"),
        F.col("ts").cast("date").cast("string").alias("d"),
    )


@query(f"""SELECT event_id, nullif(trim(s),'') AS s, CAST(TRY_CAST(i AS DOUBLE) AS BIGINT) AS i, TRY_CAST(nullif(x,'') AS DOUBLE) AS x,
  CASE WHEN lower(trim(b)) IN ('true','1','1.0') THEN true WHEN lower(trim(b)) IN ('false','0','0.0') THEN false END AS b, CAST(d AS DATE) AS d FROM {RAW}""")
def normalize_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = contracts.normalize_dataframe(raw_events(spark, sf_dir), string=["s"], integer=["i"], numeric=["x"], binary=["b"], datetime=["d"], unique="event_id")
    return made.withColumn("d", F.col("d").cast("date"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, p FROM (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice END AS p FROM lineitem) WHERE p IS NOT NULL""")
def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("l_linenumber") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice"))
    return contracts.clean(table(spark, sf_dir, "lineitem").withColumn("p", price), ["l_orderkey", "l_linenumber", "l_quantity", "p", "absent"])


@query("""SELECT l_orderkey, l_linenumber, coalesce(a,0) AS a, coalesce(b,0) AS b FROM (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END AS a,
  CASE WHEN l_linenumber % 2 <> 0 THEN l_discount END AS b FROM lineitem) WHERE a IS NOT NULL OR b IS NOT NULL""")
def match_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", n, F.when(n % 3 != 0, F.col("l_tax")).alias("a"), F.when(n % 2 != 0, F.col("l_discount")).alias("b"))
    return contracts.match_sample(rows, ["a", "b"], "outer")


@query("""SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '1234567' WHEN o_orderkey % 4 = 2 THEN '12,34' ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE) AS amount FROM orders""")
def null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, " NA ").when(k % 4 == 1, "1,234, 567").when(k % 4 == 2, "12,34").otherwise(k.cast("string"))
    return table(spark, sf_dir, "orders").select(k, contracts.null_numeric_tokens(raw).try_cast("double").alias("amount"))


@query("SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS lender, 'orders' AS source FROM orders WHERE o_totalprice > 100000")
def canonical_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [("id", "o_orderkey", "bigint"), ("amount", "o_totalprice", "double"), ("lender", "o_lender", "string")]
    return contracts.canonical(table(spark, sf_dir, "orders"), columns, {"source": "orders"}).where("amount > 100000")


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN c_mktsegment END AS segment FROM customer")
def fixed_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", contracts.domain(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("segment"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', chr(1), 'g'), '\s*' || chr(1) || '\s*', '', 'g') AS plain FROM pages""")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS INTEGER) AS n_tokens FROM documents")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query(r"""SELECT doc_id, md5(replace(regexp_replace(replace(text, '\%', chr(1)), '%[^\n]*\n?', '', 'g'), chr(1), '\%')) AS digest FROM documents""")
def remove_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.remove_comments(F.col("text"))).alias("digest"))


@query("""SELECT event_id, CASE event_type WHEN 'add_to_cart' THEN 'addToCart' ELSE event_type END AS camel FROM events""")
def camel_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.to_camel_case(F.col("event_type")).alias("camel"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
