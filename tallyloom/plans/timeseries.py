"""Lag, calendar, resample, filter and trend queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import panel
from tallyloom.operators.joins import load_outer, merge_date_many
from tallyloom.plans.aggregates import rounded
from tallyloom.plans.registry import Catalogue
from tallyloom.plans.session import table

catalogue = Catalogue()
query = catalogue.query

DAILY = "(SELECT CAST(ts AS DATE) AS day, sum(value) AS v, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1)"
MONTHLY = "(SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS total, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return rows.groupBy("day").agg(F.sum("value").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("month", panel.period_start(F.col("o_orderdate"), "month"))
    return rows.groupBy("month").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).cast("double").alias("n"))


def by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months in which each customer ordered; between them are gaps."""
    rows = table(spark, sf_dir, "orders").withColumn("month", panel.period_start(F.col("o_orderdate"), "month"))
    return rows.groupBy("o_custkey", "month").agg((F.sum("o_totalprice") / 71.93).alias("total"))


CUSTOMER = """(SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice)/71.93 AS total FROM orders GROUP BY 1,2)"""


@query(f"SELECT day, round(v,4) AS v, round(lag(v,1) OVER (ORDER BY day),4) AS L1_v, round(lead(v,2) OVER (ORDER BY day),4) AS F2_v FROM {DAILY}")
def lag_lead_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.add_lags(daily(spark, sf_dir).select("day", "v"), "v", [1, -2], ["day"]), 4, "v", "L1_v", "F2_v")


@query("""SELECT event_id, round(lag(value,1) OVER w,6) AS L1_value, round(lag(value,2) OVER w,6) AS L2_value, round(lead(value,1) OVER w,6) AS F1_value
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = panel.add_lags(table(spark, sf_dir, "events"), "value", [1, 2, -1], ["ts", "event_id"], ["user_id"])
    return rounded(made.select("event_id", "L1_value", "L2_value", "F1_value"), 6, "L1_value", "L2_value", "F1_value")


@query("SELECT event_id, round(lag(value,3) OVER (PARTITION BY user_id ORDER BY ts, event_id),6) AS value FROM events")
def panel_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = panel.panel_shift(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["value"], 3)
    return rounded(made.select("event_id", "value"), 6, "value")


@query(f"""SELECT month, round(lag(d) OVER (ORDER BY month),8) AS L_D_LOG_total FROM
  (SELECT month, ln(total) - lag(ln(total)) OVER (ORDER BY month) AS d FROM {MONTHLY})""")
def transform_lag_diff_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = panel.transform(monthly(spark, sf_dir), ["total"], ["month"], function="log", diff=1, lag=1)
    return rounded(made.select("month", "L_D_LOG_total"), 8, "L_D_LOG_total")


@query(f"""WITH p AS {CUSTOMER} SELECT a.o_custkey, a.month, round(a.total,4) AS total, round(b.total,4) AS L1_total, round(c.total,4) AS L2_total FROM p a
  LEFT JOIN p b ON a.o_custkey = b.o_custkey AND b.month = CAST(a.month - INTERVAL 1 MONTH AS DATE)
  LEFT JOIN p c ON a.o_custkey = c.o_custkey AND c.month = CAST(a.month - INTERVAL 2 MONTH AS DATE)""")
def calendar_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = panel.calendar_lags(by_customer(spark, sf_dir), "total", "month", [1, 2], "month", ["o_custkey"])
    return rounded(made, 4, "total", "L1_total", "L2_total")


@query(f"""WITH p AS {CUSTOMER}, s AS (SELECT o_custkey, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM p GROUP BY 1)
  SELECT s.o_custkey, s.month, round(p.total,4) AS total FROM s LEFT JOIN p USING (o_custkey, month)""")
def to_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.to_panel(by_customer(spark, sf_dir), ["o_custkey"], "month", "month"), 4, "total")


@query("""WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
  d AS (SELECT user_id, day, sum(value) AS s, arg_min(value, ts) AS f, arg_max(value, ts) AS l, count(value) AS c FROM e GROUP BY 1,2),
  p AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1)
  SELECT p.user_id, p.day AS ts, round(coalesce(s,0),4) AS value_sum, round(f,4) AS value_first, round(l,4) AS value_last, coalesce(c,0) AS value_count
  FROM p LEFT JOIN d USING (user_id, day)""")
def resample_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    made = panel.resample(rows, "ts", "day", {"sum": ["value"], "first": ["value"], "last": ["value"], "count": ["value"]}, ["user_id"])
    return rounded(made, 4, "value_sum", "value_first", "value_last")


@query(f"""SELECT month, CASE WHEN count(total) OVER w = 4 THEN round(sum(total) OVER w,4) END AS total4 FROM {MONTHLY}
  WINDOW w AS (ORDER BY month ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def rolling_sum_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = monthly(spark, sf_dir).withColumn("total4", panel.rolling_full(F.col("total"), 4, Window.orderBy("month")))
    return rounded(made.select("month", "total4"), 4, "total4")


@query(f"""SELECT month, round(exp(sum(ln(1+r)) OVER (ORDER BY month)),8) AS price FROM
  (SELECT month, coalesce(total/lag(total) OVER (ORDER BY month) - 1, 0) AS r FROM {MONTHLY})""")
def cumprod_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.orderBy("month")
    made = monthly(spark, sf_dir).withColumn("r", F.coalesce(F.col("total") / F.lag("total").over(w) - 1, F.lit(0.0)))
    return rounded(made.select("month", panel.cumulative_product(F.col("r"), w).alias("price")), 8, "price")


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, make_date(year(o_orderdate), 3*(quarter(o_orderdate)-1)+1, 1) AS start,
  count(*) AS n FROM orders GROUP BY 1,2,3""")
def date_from_qtr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
    return rows.withColumn("start", panel.quarter_start(F.col("y"), F.col("q"))).groupBy("y", "q", "start").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS start FROM orders""")
def date_from_q_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    rows = table(spark, sf_dir, "orders").select(label.alias("label")).distinct()
    return rows.withColumn("start", panel.quarter_of_string(F.col("label")))


@query(f"""SELECT month, CAST(DATE '2000-01-01' + to_months(CAST(3*(row_number() OVER (ORDER BY month)-1) AS INTEGER)) AS DATE) AS date FROM {MONTHLY}""")
def positional_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.positional_dates(monthly(spark, sf_dir).select("month"), "2000-01-01", "quarter", ["month"])


SHIPPED = "(SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS shipped, avg(l_tax) AS tax FROM lineitem GROUP BY 1)"
EVENTS_MONTH = "(SELECT CAST(date_trunc('month', ts) AS DATE) AS month, sum(value) AS value FROM events GROUP BY 1)"


def monthly_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    items = table(spark, sf_dir, "lineitem").groupBy(panel.period_start(F.col("l_shipdate"), "month").alias("month"))
    events = table(spark, sf_dir, "events").groupBy(panel.period_start(F.col("ts"), "month").alias("month"))
    return {
        "orders": monthly(spark, sf_dir).select("month", "total"),
        "items": items.agg(F.sum("l_quantity").alias("shipped"), F.avg("l_tax").alias("tax")),
        "events": events.agg(F.sum("value").alias("value")),
    }


@query(f"""SELECT month, round(total,4) AS total, round(shipped,4) AS shipped, round(tax,6) AS tax, round(value,4) AS value
  FROM {MONTHLY} FULL JOIN {SHIPPED} USING (month) FULL JOIN {EVENTS_MONTH} USING (month)""")
def merge_date_many_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merge_date_many(list(monthly_tables(spark, sf_dir).values()), "month")
    return rounded(rounded(made, 4, "total", "shipped", "value"), 6, "tax")


@query(f"""SELECT month, round(total,4) AS total, round(shipped,4) AS items_shipped, round(tax,6) AS items_tax, round(value,4) AS value
  FROM {MONTHLY} FULL JOIN {SHIPPED} USING (month) FULL JOIN {EVENTS_MONTH} USING (month)""")
def dataset_load_outer_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = load_outer(monthly_tables(spark, sf_dir), "month")
    return rounded(rounded(made, 4, "total", "items_shipped", "value"), 6, "items_tax")


@query(f"""WITH i AS (SELECT month, tax*20 AS cpi FROM {SHIPPED}) SELECT month, round(total/cpi,4) AS DEF_total, round(ln(total)-ln(cpi),6) AS DEF_lt
  FROM {MONTHLY} JOIN i USING (month)""")
def deflate_level_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = monthly_tables(spark, sf_dir)
    prices = tables["items"].select("month", (F.col("tax") * 20).alias("cpi"))
    rows = tables["orders"].withColumn("lt", F.ln("total"))
    level = panel.deflate(rows, prices, "month", ["total"], "cpi").select("month", "DEF_total")
    logs = panel.deflate(rows, prices, "month", ["lt"], "cpi", log=True).select("month", "DEF_lt")
    return rounded(rounded(level.join(logs, "month"), 4, "DEF_total"), 6, "DEF_lt")


@query("""WITH d AS """ + DAILY + """ SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT CAST({k} AS INTEGER) AS lag, round(corr(v, b),6) AS corr FROM (SELECT v, {'lag' if k >= 0 else 'lead'}(n, {abs(k)}) OVER (ORDER BY day) AS b FROM d)" for k in range(-3, 4)
) + ")")
def lead_lag_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.lead_lag_correlations(daily(spark, sf_dir), "v", "n", range(-3, 4), ["day"]), 6, "corr")


@query("""WITH d AS """ + DAILY + """ SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT CAST({k} AS INTEGER) AS lag, round(corr(v, b),6) AS corr FROM (SELECT v, lag(v, {k}) OVER (ORDER BY day) AS b FROM d)" for k in range(6)
) + ")")
def autocorrelations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.lead_lag_correlations(daily(spark, sf_dir), "v", "v", range(6), ["day"]), 6, "corr")


def filter_sql(weights: list[str]) -> str:
    terms = " + ".join(f"({b})*(lag(v,{h}) OVER w + lead(v,{h}) OVER w)" if h else f"({b})*v" for h, b in enumerate(weights))
    return f"SELECT day, round({terms},4) AS smooth FROM {DAILY} WINDOW w AS (ORDER BY day)"


def low_sql(period: float, n: int) -> list[str]:
    raw = [f"{2 / period}"] + [f"sin({2 * h / period}*pi())/(pi()*{h})" for h in range(1, n + 1)]
    gap = f"(1-(({raw[0]})+2*({'+'.join(raw[1:])})))/{2 * n + 1}"
    return [f"({r})+{gap}" for r in raw]


@query(filter_sql(low_sql(7.0, 4)))
def lowpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    made = panel.lowpass(F.col("v"), 2 * math.pi / 7.0, 4, Window.orderBy("day"))
    return rounded(daily(spark, sf_dir).select("day", made.alias("smooth")), 4, "smooth")


@query(filter_sql([f"({a})-({b})" for a, b in zip(low_sql(3.0, 4), low_sql(10.0, 4), strict=True)]))
def bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = panel.bandpass(F.col("v"), 3.0, 10.0, 4, Window.orderBy("day"))
    return rounded(daily(spark, sf_dir).select("day", made.alias("smooth")), 4, "smooth")


@query(f"""WITH m AS (SELECT month, total, CAST(row_number() OVER (ORDER BY month) AS DOUBLE) AS t FROM {MONTHLY}), c AS (SELECT regr_slope(total, t) AS b, regr_intercept(total, t) AS a FROM m)
  SELECT month, round(a+b*t,2) AS total_trend, round(total-a-b*t,2) AS total_detrend FROM m, c""")
def detrend_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = panel.detrend_time(monthly(spark, sf_dir), ["total"], ["month"])
    return rounded(made.select("month", "total_trend", "total_detrend"), 2, "total_trend", "total_detrend")


@query(f"""WITH d AS {DAILY}, p AS (SELECT a.day, a.n, count(*) AS c, regr_slope(b.v, b.n) AS s, regr_intercept(b.v, b.n) AS i FROM d a LEFT JOIN d b ON b.day < a.day GROUP BY 1,2)
  SELECT day, CASE WHEN c >= 5 THEN round(i + s*n,3) END AS forecast FROM p""")
def rolling_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = panel.rolling_forecast(daily(spark, sf_dir), "v", "n", ["day"], 5)
    return rounded(made.select("day", "forecast"), 3, "forecast")


@query("""SELECT event_type, round(regr_intercept(value, b),6) AS level, round(regr_slope(value, b),6) AS rho, count(b) AS n
  FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY 1""")
def fit_ar1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.fit_ar1(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], ["event_type"]), 6, "level", "rho")


@query(f"""WITH p AS {CUSTOMER}, s AS (SELECT o_custkey, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM p GROUP BY 1),
  f AS (SELECT s.o_custkey, s.month, p.total FROM s LEFT JOIN p USING (o_custkey, month)),
  g AS (SELECT *, max(CASE WHEN total IS NOT NULL THEN month END) OVER (PARTITION BY o_custkey ORDER BY month) AS a,
    min(CASE WHEN total IS NOT NULL THEN month END) OVER (PARTITION BY o_custkey ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM f)
  SELECT g.o_custkey, g.month, round(CASE WHEN g.total IS NOT NULL THEN g.total ELSE x.total + (y.total-x.total)*(g.month-g.a)/(g.b-g.a) END,4) AS total_filled
  FROM g LEFT JOIN p x ON x.o_custkey = g.o_custkey AND x.month = g.a LEFT JOIN p y ON y.o_custkey = g.o_custkey AND y.month = g.b""")
def interpolate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = panel.to_panel(by_customer(spark, sf_dir), ["o_custkey"], "month", "month")
    made = panel.interpolate_linear(full, "total", "month", ["o_custkey"])
    return rounded(made.select("o_custkey", "month", "total_filled"), 4, "total_filled")


@query("""WITH r AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice*(day(last_day(o_orderdate))-day(o_orderdate)+1)/day(last_day(o_orderdate)) AS h, o_totalprice AS x FROM orders),
  m AS (SELECT month, sum(h) AS h, sum(x-h) AS n FROM r GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m)
  SELECT month, round(coalesce(h,0)+coalesce(lag(coalesce(n,0)) OVER (ORDER BY month),0),3) AS total FROM s LEFT JOIN m USING (month)""")
def shock_month_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.allocate_to_months(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), 3, "total")


@query("""SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, round(100*(1-exp(12*avg(ln(power(1-0.01*(l_discount*100),1.0/12))))),6) AS cpr FROM lineitem GROUP BY 1""")
def cpr_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    survival = F.ln(F.pow(1 - 0.01 * (F.col("l_discount") * 100), F.lit(1.0 / 12)))
    rows = table(spark, sf_dir, "lineitem").groupBy(panel.period_start(F.col("l_shipdate"), "quarter").alias("quarter"))
    return rounded(rows.agg((100 * (1 - F.exp(12 * F.avg(survival)))).alias("cpr")), 6, "cpr")
