"""Collapse, quantile, inequality and bin queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import bins, collapse, quantiles
from tallyloom.plans.registry import Catalogue
from tallyloom.plans.session import table

catalogue = Catalogue()
query = catalogue.query

FLAGS = ["l_returnflag", "l_linestatus"]


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose price is missing on every seventh line number."""
    return lineitem(spark, sf_dir).withColumn("price", F.when(F.col("l_linenumber") % 7 != 0, F.col("l_extendedprice")))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("""SELECT l_returnflag, l_linestatus,
  round(sum(l_extendedprice*l_quantity)/nullif(sum(CASE WHEN l_extendedprice IS NOT NULL THEN l_quantity END),0),4) AS l_extendedprice,
  round(sum(l_discount*l_quantity)/nullif(sum(CASE WHEN l_discount IS NOT NULL THEN l_quantity END),0),4) AS l_discount
  FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1,2""")
def collapse_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = collapse.collapse(lineitem(spark, sf_dir), FLAGS, ["l_extendedprice", "l_discount"], "l_quantity")
    return rounded(made, 4, "l_extendedprice", "l_discount")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_tax*l_quantity),4) AS l_tax FROM lineitem GROUP BY 1,2")
def collapse_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(collapse.collapse(lineitem(spark, sf_dir), FLAGS, ["l_tax"], "l_quantity", as_sum=True), 4, "l_tax")


@query("""SELECT l_returnflag, round(sum(p*q)/sum(CASE WHEN p IS NOT NULL THEN q END),4) AS price,
  round(sum(CASE WHEN p IS NOT NULL THEN q END),4) AS price_denom
  FROM (SELECT l_returnflag, l_quantity AS q, CASE WHEN l_linenumber % 7 <> 0 THEN l_extendedprice END AS p FROM lineitem) GROUP BY 1""")
def collapse_with_denom(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = collapse.Collapser.of(with_gaps(spark, sf_dir), ["price"], ["l_returnflag"], "l_quantity").means(with_denominators=True)
    return rounded(made, 4, "price", "price_denom")


@query("""SELECT l_returnflag, round(sum(p*q)/sum(q),4) AS price
  FROM (SELECT l_returnflag, l_quantity AS q, CASE WHEN l_linenumber % 7 <> 0 THEN l_extendedprice END AS p FROM lineitem) GROUP BY 1""")
def collapse_naive_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(collapse.collapse_all_weights(with_gaps(spark, sf_dir), ["l_returnflag"], ["price"], "l_quantity"), 4, "price")


@query("SELECT l_returnflag, round(sum(l_tax*l_quantity)/sum(l_quantity),6) AS l_tax FROM lineitem GROUP BY 1")
def collapse_recollapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = collapse.Collapser.of(lineitem(spark, sf_dir), ["l_tax"], FLAGS, "l_quantity").collapse(["l_returnflag"])
    return rounded(made.means(), 6, "l_tax")


@query("SELECT l_returnflag, round(sum(l_tax*l_quantity)/sum(l_quantity),6) AS l_tax FROM lineitem GROUP BY 1")
def collapse_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir)
    cut = F.lit("1995-06-17").cast("timestamp_ntz")
    halves = [rows.where(F.col("l_shipdate") < cut), rows.where(F.col("l_shipdate") >= cut)]
    parts = [collapse.Collapser.of(h, ["l_tax"], ["l_returnflag"], "l_quantity") for h in halves]
    return rounded(collapse.concat(parts).means(), 6, "l_tax")


@query("""SELECT l_linestatus, round(sum(l_extendedprice*l_quantity)/sum(l_quantity),4) AS l_extendedprice,
  round(sum(l_discount*l_extendedprice)/sum(l_extendedprice),6) AS l_discount FROM lineitem GROUP BY 1""")
def collapse_multiweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = collapse.collapse_multiweight(lineitem(spark, sf_dir), ["l_linestatus"], {"l_extendedprice": "l_quantity", "l_discount": "l_extendedprice"})
    return rounded(rounded(made, 4, "l_extendedprice"), 6, "l_discount")


def quantile_sql(key: str, x: str, w: str, qs: list[float], name: str, source: str = "lineitem", pk: str = "l_orderkey, l_linenumber") -> str:
    """Weighted quantiles on mid-point weights, interpolated."""
    parts = ", ".join(
        f"""round(CASE WHEN lo{i} IS NULL THEN hi{i}.x WHEN hi{i} IS NULL THEN lo{i}.x
        ELSE lo{i}.x + (hi{i}.x - lo{i}.x) * ({q} - lo{i}.g) / (hi{i}.g - lo{i}.g) END, 4) AS {name}{n}"""
        for i, (q, n) in enumerate((q, f"_p{100 * q:g}".replace(".", "_")) for q in qs)
    )
    ends = ", ".join(
        f"max({{'g': g, 'x': x}}) FILTER (WHERE g <= {q}) AS lo{i}, min({{'g': g, 'x': x}}) FILTER (WHERE g > {q}) AS hi{i}" for i, q in enumerate(qs)
    )
    return f"""SELECT k AS {key}, {parts} FROM (SELECT k, {ends} FROM (
      SELECT {key} AS k, {x} AS x, (sum({w}) OVER (PARTITION BY {key} ORDER BY {x}, {w}, {pk} ROWS UNBOUNDED PRECEDING) - 0.5*{w})
        / sum({w}) OVER (PARTITION BY {key}) AS g FROM {source} WHERE {w} > 0 AND {x} IS NOT NULL) GROUP BY k)"""


@query(quantile_sql("l_returnflag", "l_extendedprice", "l_quantity", [0.5], "l_extendedprice"))
def collapse_quantile_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quantiles.weighted_quantiles(lineitem(spark, sf_dir), ["l_returnflag"], "l_extendedprice", "l_quantity", [0.5])
    return rounded(made, 4, "l_extendedprice_p50")


@query(quantile_sql("l_returnflag", "l_extendedprice", "l_quantity", [0.1, 0.5, 0.9], "l_extendedprice"))
def collapse_multiquantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quantiles.weighted_quantiles(lineitem(spark, sf_dir), ["l_returnflag"], "l_extendedprice", "l_quantity", [0.1, 0.5, 0.9])
    return rounded(made, 4, *made.columns[1:])


@query(f"""SELECT l_linestatus, l_extendedprice_p25, l_extendedprice_p75, l_tax_p25, l_tax_p75
  FROM ({quantile_sql("l_linestatus", "l_extendedprice", "l_quantity", [0.25, 0.75], "l_extendedprice")})
  JOIN ({quantile_sql("l_linestatus", "l_tax", "l_extendedprice", [0.25, 0.75], "l_tax")}) USING (l_linestatus)""")
def collapse_multiweight_multiquantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"l_extendedprice": "l_quantity", "l_tax": "l_extendedprice"}
    made = quantiles.collapse_multiweight_quantiles(lineitem(spark, sf_dir), ["l_linestatus"], weights, [0.25, 0.75])
    return rounded(made, 4, *made.columns[1:])


@query("SELECT event_type, round(quantile_cont(value, 0.5),6) AS value_p50, round(quantile_cont(value, 0.9),6) AS value_p90 FROM events GROUP BY 1")
def collapse_median_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quantiles.group_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.9])
    return rounded(made, 6, "value_p50", "value_p90")


@query("""SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS o_orderdate, round(sum(o_totalprice*o_totalprice)/sum(o_totalprice),4) AS o_totalprice
  FROM orders GROUP BY 1,2""")
def collapse_resample_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = collapse.Collapser.of(table(spark, sf_dir, "orders"), ["o_totalprice"], ["o_orderpriority", "o_orderdate"], "o_totalprice")
    return rounded(made.resample("o_orderdate", "month").means(), 4, "o_totalprice")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_tax*l_quantity)/sum(l_quantity),6) AS l_tax FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def collapse_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(collapse.Collapser.of(lineitem(spark, sf_dir), ["l_tax"], FLAGS, "l_quantity").rollup(), 6, "l_tax")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_tax*l_quantity)/sum(l_quantity),6) AS l_tax FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def collapse_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(collapse.Collapser.of(lineitem(spark, sf_dir), ["l_tax"], FLAGS, "l_quantity").rollup(cube=True), 6, "l_tax")


@query("""WITH m AS (SELECT l_returnflag, sum(l_tax*l_quantity)/sum(l_quantity) AS mean FROM lineitem GROUP BY 1)
  SELECT l_returnflag, round(mean,6) AS mean, round(sum(l_quantity*(l_tax-mean)*(l_tax-mean))/sum(l_quantity),8) AS var,
  round(sqrt(sum(l_quantity*(l_tax-mean)*(l_tax-mean))/sum(l_quantity)),8) AS std FROM lineitem JOIN m USING (l_returnflag) GROUP BY l_returnflag, mean""")
def weighted_mean_var_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = collapse.weighted_moments(lineitem(spark, sf_dir), ["l_returnflag"], "l_tax", "l_quantity")
    return rounded(rounded(made, 6, "mean"), 8, "var", "std")


@query("""SELECT l_returnflag, CASE WHEN count(p) = count(*) THEN round(sum(p),4) END AS price, round(sum(l_tax),4) AS tax
  FROM (SELECT *, CASE WHEN l_linenumber % 7 <> 0 OR l_returnflag <> 'A' THEN l_extendedprice END AS p FROM lineitem) GROUP BY 1""")
def safe_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when((F.col("l_linenumber") % 7 != 0) | (F.col("l_returnflag") != "A"), F.col("l_extendedprice"))
    rows = lineitem(spark, sf_dir).withColumn("p", p)
    return rounded(rows.groupBy("l_returnflag").agg(collapse.safe_sum("p").alias("price"), collapse.safe_sum("l_tax").alias("tax")), 4, "price", "tax")


GINI_POINTS = """WITH g AS (SELECT c_acctbal AS v, CAST(count(*) AS DOUBLE) AS w FROM customer WHERE c_acctbal > 0 GROUP BY 1),
  c AS (SELECT v, sum(w) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS p,
    sum(v*w) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) / sum(v*w) OVER () AS s FROM g)"""


@query(GINI_POINTS + """, l AS (SELECT p, s, lag(p) OVER (ORDER BY v) AS p0, lag(s) OVER (ORDER BY v) AS s0 FROM c)
  SELECT round(1 - 2*sum((s+s0)/2*(p-p0)),6) AS gini FROM l""")
def gini_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quantiles.gini_trapezoid(table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_acctbal"), 6, "gini")


@query(GINI_POINTS + """, l AS (SELECT row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n, s, lag(s) OVER (ORDER BY v) AS s1,
    lag(s,2) OVER (ORDER BY v) AS s2, p - lag(p) OVER (ORDER BY v) AS h1, lag(p) OVER (ORDER BY v) - lag(p,2) OVER (ORDER BY v) AS h0 FROM c)
  SELECT round(1 - 2*sum(CASE WHEN i >= 3 AND i % 2 = 1 AND i <= n - (1 - n % 2)
      THEN (h0+h1)/6*((2-h1/h0)*s2 + (h0+h1)*(h0+h1)/(h0*h1)*s1 + (2-h0/h1)*s)
    WHEN i = n AND n % 2 = 0 AND i >= 3 THEN (2*h1*h1+3*h0*h1)/(6*(h0+h1))*s + (h1*h1+3*h0*h1)/(6*h0)*s1 - h1*h1*h1/(6*h0*(h0+h1))*s2
    ELSE 0 END),6) AS gini FROM l""")
def gini_simpson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quantiles.gini_simpson(table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_acctbal"), 6, "gini")


@query("""WITH r AS (SELECT o_totalprice AS x, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 0.5) / count(*) OVER () AS g FROM orders),
  p AS (SELECT unnest([0.01, 0.1, 0.5]) AS top),
  q AS (SELECT top, max({'g': g, 'x': x}) FILTER (WHERE g <= 1-top) AS lo, min({'g': g, 'x': x}) FILTER (WHERE g > 1-top) AS hi FROM r, p GROUP BY top),
  c AS (SELECT top, lo.x + (hi.x-lo.x)*(1-top-lo.g)/(hi.g-lo.g) AS cut FROM q)
  SELECT CAST(top AS DOUBLE) AS top, round(sum(CASE WHEN x >= cut THEN x END)/sum(x),6) AS share FROM r, c GROUP BY top""")
def top_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quantiles.top_shares(table(spark, sf_dir, "orders"), "o_totalprice", [0.01, 0.1, 0.5]), 6, "share")


TENTHS = "[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]"


@query(f"""WITH e AS (SELECT list_distinct(quantile_cont(l_extendedprice, {TENTHS})) AS q FROM lineitem)
  SELECT l_orderkey, l_linenumber, CAST(len(list_filter(q, lambda x: l_extendedprice > x)) AS INTEGER) AS bin FROM lineitem, e""")
def bin_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.bin_data(lineitem(spark, sf_dir), "l_extendedprice", 10, "bin").select("l_orderkey", "l_linenumber", "bin")


@query("""WITH r AS (SELECT *, (sum(l_quantity) OVER (ORDER BY l_extendedprice, l_quantity, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) - 0.5*l_quantity)
    / sum(l_quantity) OVER () AS g FROM lineitem), p AS (SELECT unnest([0.25,0.5,0.75]) AS q),
  e AS (SELECT q, max({'g': g, 'x': l_extendedprice}) FILTER (WHERE g <= q) AS lo, min({'g': g, 'x': l_extendedprice}) FILTER (WHERE g > q) AS hi FROM r, p GROUP BY q),
  c AS (SELECT list(lo.x + (hi.x-lo.x)*(q-lo.g)/(hi.g-lo.g)) AS cuts FROM e)
  SELECT CAST(len(list_filter(cuts, lambda x: l_extendedprice > x)) AS INTEGER) AS bin, count(*) AS n FROM lineitem, c GROUP BY 1""")
def bin_data_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bins.bin_data(lineitem(spark, sf_dir), "l_extendedprice", 4, "bin", "l_quantity")
    return made.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH e AS (SELECT list_distinct(quantile_cont(l_quantity, {TENTHS})) AS q FROM lineitem),
  b AS (SELECT CAST(len(list_filter(q, lambda x: l_quantity > x)) AS INTEGER) AS bin, l_quantity, l_extendedprice FROM lineitem, e)
  SELECT bin, round(avg(l_quantity),6) AS x, round(avg(l_extendedprice),4) AS y FROM b GROUP BY 1""")
def binscatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bins.binscatter(lineitem(spark, sf_dir), "l_extendedprice", "l_quantity", 10)
    return rounded(rounded(made, 6, "x"), 4, "y")


@query(f"""WITH e AS (SELECT list_distinct(quantile_cont(l_quantity, {TENTHS})) AS q FROM lineitem),
  b AS (SELECT CAST(len(list_filter(q, lambda x: l_quantity > x)) AS INTEGER) AS bin, l_quantity, l_extendedprice FROM lineitem, e)
  SELECT bin, round(median(l_quantity),6) AS x, round(median(l_extendedprice),4) AS y FROM b GROUP BY 1""")
def binscatter_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bins.binscatter(lineitem(spark, sf_dir), "l_extendedprice", "l_quantity", 10, median=True)
    return rounded(rounded(made, 6, "x"), 4, "y")


@query("""WITH e AS (SELECT quantile_cont(p_retailprice, [0.25,0.5,0.75]) AS q FROM part)
  SELECT p_partkey, CAST(p_retailprice < q[1] AS INTEGER) AS p_retailprice_bin1, CAST(p_retailprice >= q[1] AND p_retailprice < q[2] AS INTEGER) AS p_retailprice_bin2,
  CAST(p_retailprice >= q[2] AND p_retailprice < q[3] AS INTEGER) AS p_retailprice_bin3, CAST(p_retailprice >= q[3] AS INTEGER) AS p_retailprice_bin4 FROM part, e""")
def bin_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bins.bin_dummies(table(spark, sf_dir, "part"), "p_retailprice", 4)
    return made.select("p_partkey", *(f"p_retailprice_bin{i}" for i in range(1, 5)))


@query("""WITH b AS (SELECT CASE WHEN l_quantity = 50 THEN 9 ELSE CAST(floor(l_quantity / 5) AS BIGINT) END AS bin FROM lineitem WHERE l_quantity BETWEEN 0 AND 50)
  SELECT s.bin AS bin, count(b.bin) AS n FROM (SELECT unnest(range(10)) AS bin) s LEFT JOIN b USING (bin) GROUP BY 1""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.histogram(lineitem(spark, sf_dir), "l_quantity", 0, 50, 10)


@query("""WITH b AS (SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 0 WHEN l_quantity > 10 AND l_quantity <= 25 THEN 10
    WHEN l_quantity > 25 AND l_quantity <= 45 THEN 25 END AS e, l_extendedprice AS w FROM lineitem)
  SELECT CAST(e AS DOUBLE) AS "left", round(sum(w)/(SELECT sum(w) FROM b WHERE e IS NOT NULL),6) AS share FROM b WHERE e IS NOT NULL GROUP BY 1
  UNION ALL SELECT 45.0, 0.0 WHERE false""")
def weighted_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bins.share_histogram(lineitem(spark, sf_dir), "l_quantity", [0, 10, 25, 45], "l_extendedprice"), 6, "share")


@query("""WITH b AS (SELECT CASE WHEN least(l_quantity,40) = 40 THEN 7 ELSE CAST(floor(least(l_quantity,40) / 5) AS BIGINT) END AS bin FROM lineitem)
  SELECT s.bin AS bin, count(b.bin) AS n FROM (SELECT unnest(range(8)) AS bin) s LEFT JOIN b USING (bin) GROUP BY 1""")
def hist_topcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir).withColumn("q", bins.topcode(F.col("l_quantity"), 0, 40))
    return bins.histogram(rows, "q", 0, 40, 8)


@query("""WITH e AS (SELECT quantile_cont(l_extendedprice, [0.01,0.99]) AS q FROM lineitem)
  SELECT l_returnflag, round(sum(least(greatest(l_extendedprice, q[1]), q[2]))/count(*),4) AS mean, round(min(least(greatest(l_extendedprice, q[1]), q[2])),4) AS low,
  round(max(least(greatest(l_extendedprice, q[1]), q[2])),4) AS high FROM lineitem, e GROUP BY 1""")
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bins.winsorize(lineitem(spark, sf_dir), ["l_extendedprice"], 0.98)
    return summary_of(made)


def summary_of(df: DataFrame) -> DataFrame:
    x = "l_extendedprice"
    return rounded(df.groupBy("l_returnflag").agg(F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high")), 4, "mean", "low", "high")


@query("""WITH r AS (SELECT *, (sum(l_quantity) OVER (ORDER BY l_extendedprice, l_quantity, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) - 0.5*l_quantity)
    / sum(l_quantity) OVER () AS g FROM lineitem), p AS (SELECT unnest([0.05, 0.95]) AS q),
  e AS (SELECT q, max({'g': g, 'x': l_extendedprice}) FILTER (WHERE g <= q) AS lo, min({'g': g, 'x': l_extendedprice}) FILTER (WHERE g > q) AS hi FROM r, p GROUP BY q),
  c AS (SELECT min(lo.x + (hi.x-lo.x)*(q-lo.g)/(hi.g-lo.g)) AS a, max(lo.x + (hi.x-lo.x)*(q-lo.g)/(hi.g-lo.g)) AS b FROM e)
  SELECT l_returnflag, round(avg(least(greatest(l_extendedprice, a), b)),4) AS mean, round(min(least(greatest(l_extendedprice, a), b)),4) AS low,
  round(max(least(greatest(l_extendedprice, a), b)),4) AS high FROM lineitem, c GROUP BY 1""")
def winsorize_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_of(bins.winsorize(lineitem(spark, sf_dir), ["l_extendedprice"], 0.9, "l_quantity"))


@query("""SELECT CAST(l_shipdate AS DATE) AS ship, round(sum(l_extendedprice*l_quantity)/sum(l_extendedprice),6) AS l_quantity,
  round(sum(l_extendedprice*l_tax)/sum(l_extendedprice),6) AS l_tax FROM lineitem GROUP BY 1""")
def weighted_agg_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir).withColumn("ship", F.col("l_shipdate").cast("date"))
    made = collapse.collapse_all_weights(rows, ["ship"], ["l_quantity", "l_tax"], "l_extendedprice")
    return rounded(made, 6, "l_quantity", "l_tax")


@query("""SELECT round(min(l_quantity) - 0.05*(max(l_quantity)-min(l_quantity)),6) AS low, round(max(l_quantity) + 0.05*(max(l_quantity)-min(l_quantity)),6) AS high FROM lineitem""")
def padded_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.min("l_quantity"), F.max("l_quantity")
    return rounded(lineitem(spark, sf_dir).agg((low - (high - low) * 0.05).alias("low"), (high + (high - low) * 0.05).alias("high")), 6, "low", "high")


@query("""SELECT event_id, round((value - avg(value) OVER ())/stddev_pop(value) OVER (),6) AS z FROM events""")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    stats = rows.agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return rows.join(F.broadcast(stats)).select("event_id", F.round((F.col("value") - F.col("_m")) / F.col("_s"), 6).alias("z"))
