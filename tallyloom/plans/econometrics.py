"""Regression, fixed-effect, projection and kernel queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import kernels, models, numerics
from tallyloom.operators import regression as reg
from tallyloom.plans.aggregates import rounded
from tallyloom.plans.least_squares import errors, fit_table, least_squares
from tallyloom.plans.registry import Catalogue
from tallyloom.plans.session import table
from tallyloom.plans.timeseries import DAILY, daily

catalogue = Catalogue()
query = catalogue.query

#: Price in thousands on quantity.
ONE = "l_extendedprice ~ l_quantity"
XY = "SELECT l_extendedprice AS y, l_quantity AS x, l_orderkey, l_linenumber, l_suppkey AS g FROM lineitem"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def table_of(fit: reg.Fit, digits: int = 3) -> DataFrame:
    return rounded(fit.table().select("term", "coef", "se"), digits, "coef", "se")


def robust_sql(weight: str, factor: str = "1") -> str:
    """Coefficients and robust errors of a line: weight is what squared residuals are multiplied with."""
    return f"""WITH d AS ({XY}), m AS (SELECT count(*) AS n, avg(x) AS mx, sum((x-(SELECT avg(x) FROM d))*(x-(SELECT avg(x) FROM d))) AS sxx,
      regr_slope(y,x) AS b, regr_intercept(y,x) AS a FROM d),
    r AS (SELECT x, y-a-b*x AS e, 1.0/n + (x-mx)*(x-mx)/sxx AS h, n, mx, sxx, a, b FROM d, m),
    s AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(e*e*{weight}*power(1.0/n - mx*(x-mx)/sxx, 2))*{factor} AS va,
      sum(e*e*{weight}*power((x-mx)/sxx, 2))*{factor} AS vb FROM r, (SELECT count(*) AS k FROM d))
    SELECT 'Intercept' AS term, round(a,3) AS coef, round(sqrt(va),3) AS se FROM s UNION ALL SELECT 'l_quantity', round(b,3), round(sqrt(vb),3) FROM s"""


@query("SELECT 'Intercept' AS term, round(regr_intercept(l_extendedprice,l_quantity),3) AS coef FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice,l_quantity),3) FROM lineitem")
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.regression(items(spark, sf_dir), ONE, cov_type="nonrobust")).select("term", "coef")


@query("""WITH d AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem), m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM d),
  s AS (SELECT sum((a-ma)*(a-ma)) AS aa, sum((b-mb)*(b-mb)) AS bb, sum((a-ma)*(b-mb)) AS ab, sum((a-ma)*(y-my)) AS ay, sum((b-mb)*(y-my)) AS by_, any_value(my) AS my, any_value(ma) AS ma, any_value(mb) AS mb FROM d, m),
  c AS (SELECT (bb*ay-ab*by_)/(aa*bb-ab*ab) AS p, (aa*by_-ab*ay)/(aa*bb-ab*ab) AS q, * FROM s)
  SELECT 'Intercept' AS term, round(my-p*ma-q*mb,2) AS coef FROM c UNION ALL SELECT 'l_quantity', round(p,2) FROM c UNION ALL SELECT 'l_discount', round(q,2) FROM c""")
def ols_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.regression(items(spark, sf_dir), "l_extendedprice ~ l_quantity + l_discount", cov_type="nonrobust"), 2).select("term", "coef")


@query(robust_sql("1"))
def ols_hc0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.regression(items(spark, sf_dir), ONE, cov_type="HC0"))


@query(robust_sql("1", "any_value(n)/(any_value(n)-2.0)"))
def ols_hc1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.regression(items(spark, sf_dir), ONE, cov_type="HC1"))


@query(robust_sql("(1/(1-h))"))
def ols_hc2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.regression(items(spark, sf_dir), ONE, cov_type="HC2"))


@query(robust_sql("(1/((1-h)*(1-h)))"))
def ols_hc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.regression(items(spark, sf_dir), ONE, cov_type="HC3"))


@query(f"""WITH d AS ({XY}), m AS (SELECT count(*) AS n, avg(x) AS mx, regr_sxx(y,x) AS sxx, regr_slope(y,x) AS b, regr_intercept(y,x) AS a, count(DISTINCT g) AS gs FROM d),
  r AS (SELECT g, sum((y-a-b*x)*(1.0/n - mx*(x-mx)/sxx)) AS ua, sum((y-a-b*x)*(x-mx)/sxx) AS ub FROM d, m GROUP BY g)
  SELECT 'Intercept' AS term, round(any_value(a),3) AS coef, round(sqrt(sum(ua*ua)*any_value(gs)/(any_value(gs)-1.0)*(any_value(n)-1.0)/(any_value(n)-2.0)),3) AS se FROM r, m
  UNION ALL SELECT 'l_quantity', round(any_value(b),3), round(sqrt(sum(ub*ub)*any_value(gs)/(any_value(gs)-1.0)*(any_value(n)-1.0)/(any_value(n)-2.0)),3) FROM r, m""")
def ols_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.regression(items(spark, sf_dir), ONE, cluster="l_suppkey"))


@query(f"""WITH d AS {DAILY}, m AS (SELECT count(*) AS c, avg(n) AS mx, regr_sxx(v,n) AS sxx, regr_slope(v,n) AS b, regr_intercept(v,n) AS a FROM d),
  r AS (SELECT day, (v-a-b*n)*(1.0/c - mx*(n-mx)/sxx) AS ua, (v-a-b*n)*(n-mx)/sxx AS ub FROM d, m),
  l AS (SELECT *, lag(ua,1) OVER (ORDER BY day) AS ua1, lag(ua,2) OVER (ORDER BY day) AS ua2, lag(ub,1) OVER (ORDER BY day) AS ub1, lag(ub,2) OVER (ORDER BY day) AS ub2 FROM r)
  SELECT 'Intercept' AS term, round((SELECT a FROM m),3) AS coef, round(sqrt(sum(ua*ua)+2*(2.0/3*sum(ua*ua1)+1.0/3*sum(ua*ua2))),3) AS se FROM l
  UNION ALL SELECT 'n', round((SELECT b FROM m),3), round(sqrt(sum(ub*ub)+2*(2.0/3*sum(ub*ub1)+1.0/3*sum(ub*ub2))),3) FROM l""")
def ols_hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.regression(daily(spark, sf_dir), "v ~ n", hac_lags=2, order=["day"]))


@query("""WITH m AS (SELECT sum(l_tax*l_quantity)/sum(l_tax) AS mx, sum(l_tax*l_extendedprice)/sum(l_tax) AS my FROM lineitem WHERE l_tax > 0),
  s AS (SELECT sum(l_tax*(l_quantity-mx)*(l_extendedprice-my))/sum(l_tax*(l_quantity-mx)*(l_quantity-mx)) AS b, any_value(mx) AS mx, any_value(my) AS my FROM lineitem, m WHERE l_tax > 0)
  SELECT 'Intercept' AS term, round(my-b*mx,3) AS coef FROM s UNION ALL SELECT 'l_quantity', round(b,3) FROM s""")
def wls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.regression(items(spark, sf_dir), ONE, weight="l_tax")).select("term", "coef")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey),4) AS l_extendedprice FROM lineitem")
def demean(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reg.demean(items(spark, sf_dir), ["l_extendedprice"], ["l_suppkey"])
    return rounded(made.select("l_orderkey", "l_linenumber", "l_extendedprice"), 4, "l_extendedprice")


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice - sum(l_extendedprice*l_quantity) OVER (PARTITION BY l_suppkey)/sum(l_quantity) OVER (PARTITION BY l_suppkey),4) AS l_extendedprice FROM lineitem""")
def demean_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reg.demean(items(spark, sf_dir), ["l_extendedprice"], ["l_suppkey"], "l_quantity")
    return rounded(made.select("l_orderkey", "l_linenumber", "l_extendedprice"), 4, "l_extendedprice")


@query("""SELECT l_orderkey, l_linenumber, round(y - avg(y) OVER (PARTITION BY l_returnflag),4) AS l_extendedprice FROM
  (SELECT *, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y FROM lineitem)""")
def demean_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reg.demean_separate(items(spark, sf_dir), ["l_extendedprice"], ["l_suppkey", "l_returnflag"])
    return rounded(made.select("l_orderkey", "l_linenumber", "l_extendedprice"), 4, "l_extendedprice")


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) + avg(l_extendedprice) OVER (),3) AS l_extendedprice FROM lineitem""")
def absorb_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reg.absorb_effects(items(spark, sf_dir), ["l_extendedprice"], ["l_suppkey"], restore_mean=True)
    return rounded(made.select("l_orderkey", "l_linenumber", "l_extendedprice"), 3, "l_extendedprice")


SWEEP = """SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, r - avg(r) OVER (PARTITION BY l_returnflag) AS r FROM
  (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, r - avg(r) OVER (PARTITION BY l_suppkey) AS r FROM ({}))"""
TWO_WAY = "SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_extendedprice AS r FROM lineitem"
for _ in range(12):
    TWO_WAY = SWEEP.format(TWO_WAY)


@query(f"SELECT l_orderkey, l_linenumber, round(r,2) AS l_extendedprice FROM ({TWO_WAY})")
def absorb_twoway(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reg.absorb_effects(items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_extendedprice"), ["l_extendedprice"], ["l_suppkey", "l_returnflag"])
    return rounded(made.select("l_orderkey", "l_linenumber", "l_extendedprice"), 2, "l_extendedprice")


@query("""WITH d AS (SELECT l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x, l_suppkey,
    count(*) OVER (PARTITION BY l_suppkey) AS c FROM lineitem), k AS (SELECT * FROM d WHERE c > 1),
  b AS (SELECT sum(x*y)/sum(x*x) AS b, sum(x*x) AS sxx, count(*) AS n, count(DISTINCT l_suppkey) AS g FROM k)
  SELECT 'l_quantity' AS term, round(any_value(b),3) AS coef, round(sqrt(sum(x*x*(y-b*x)*(y-b*x))/power(any_value(sxx),2)*any_value(n)/(any_value(n)-1-any_value(g)+1.0)),3) AS se FROM k, b""")
def hdfe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.hdfe(items(spark, sf_dir), "l_extendedprice", ["l_quantity"], ["l_suppkey"]))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n > 1")
def singleton_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.drop_singletons(items(spark, sf_dir).select("l_orderkey", "l_linenumber"), ["l_orderkey"])


def projection_sql(rows: str, y: str, xs: list[str], order: str, periods: int, digits: int) -> str:
    """Coefficient of the first of xs at each horizon, y's being columns h0, h1, ...: HC3 errors, then those of h lags."""
    parts = []
    for h in range(periods + 1):
        parts += [least_squares(f"f{h}", rows, f"h{h}", xs, order), errors(f"f{h}", len(xs), h or "hc3", order)]
    ends = (f"SELECT CAST({h} AS INTEGER) AS horizon, round(b_0, {digits}) AS coef, round(se_0, {digits}) AS se FROM f{h}_b, f{h}_e" for h in range(periods + 1))
    return "WITH " + ",\n  ".join(parts) + "\n" + " UNION ALL ".join(ends)


DAILY_PROJECTION = f"""SELECT day, n, lag(n, 1) OVER w AS n1, lag(n, 2) OVER w AS n2, lag(v, 1) OVER w AS v1, v AS h0,
  lead(v, 1) OVER w AS h1, lead(v, 2) OVER w AS h2, lead(v, 3) OVER w AS h3, lead(v, 4) OVER w AS h4 FROM {DAILY} WINDOW w AS (ORDER BY day)"""
PANEL_PROJECTION = """SELECT user_id, ts, event_id, event_id % 10 AS s, lag(event_id % 10, 1) OVER w AS s1, lag(value, 1) OVER w AS v1, value AS h0,
  lead(value, 1) OVER w AS h1, lead(value, 2) OVER w AS h2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
#: The daily series with lags 1 to 4 of both.
LAGGED = f"""SELECT day, v, n, {", ".join(f"lag({c}, {i}) OVER w AS {c}{i}" for c in "vn" for i in range(1, 5))},
  n - lag(n, 1) OVER w AS dn, v - lag(v, 1) OVER w AS dv FROM {DAILY} WINDOW w AS (ORDER BY day)"""
VAR_FITS = ",\n  ".join(least_squares(f"f{c}", LAGGED, c, ["v1", "n1"], "day") for c in "vn")


VAR_RESIDUALS = """e AS (SELECT a.y - p.b_c - p.b_0 * a.x_0 - p.b_1 * a.x_1 AS ev, b.y - q.b_c - q.b_0 * b.x_0 - q.b_1 * b.x_1 AS en
    FROM fv_r a JOIN fn_r b ON a.day = b.day, fv_b p, fn_b q)"""


def leads_and_lags(lags: int) -> str:
    """Table expressions ending in the fit f of v on n and leads and lags of its change."""
    around = range(-lags, lags + 1)
    rows = f"SELECT day, v, n, {', '.join(f'lag(dn, {i}) OVER (ORDER BY day) AS d{i + lags}' for i in around)} FROM ({LAGGED})"
    return least_squares("f", rows, "v", ["n", *(f"d{i + lags}" for i in around)], "day")


@query(projection_sql(DAILY_PROJECTION, "v", ["n", "n1", "n2", "v1"], "day", 4, 3))
def local_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reg.local_projection(daily(spark, sf_dir), "v", "n", ["day"], periods=4), 3, "coef", "se")


@query(projection_sql(PANEL_PROJECTION, "value", ["s", "s1", "v1"], "user_id, ts, event_id", 2, 4))
def lp_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("shock", F.col("event_id") % 10).select("user_id", "ts", "event_id", "value", "shock")
    return rounded(reg.local_projection(rows, "value", "shock", ["ts", "event_id"], ["user_id"], periods=2, shock_lags=1), 4, "coef", "se")


@query(
    f"WITH {VAR_FITS}\n"
    + " UNION ALL ".join(f"SELECT '{t}' AS term, '{e}' AS equation, round(b_{c}, 4) AS coef FROM f{e}_b" for e in "vn" for t, c in (("const", "c"), ("L1_v", 0), ("L1_n", 1)))
)
def var_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = reg.vector_autoregression(daily(spark, sf_dir), ["v", "n"], 1, ["day"])
    rows = [(t, x, float(fit.coef[i, j])) for i, t in enumerate(fit.terms) for j, x in enumerate(fit.variables)]
    return rounded(spark.createDataFrame(rows, "term string, equation string, coef double"), 4, "coef")


@query(
    f"""WITH RECURSIVE {VAR_FITS},
  {VAR_RESIDUALS},
  s AS (SELECT sqrt(avg(ev * ev)) AS l11, avg(ev * en) / sqrt(avg(ev * ev)) AS l21, sqrt(avg(en * en) - avg(ev * en) * avg(ev * en) / avg(ev * ev)) AS l22 FROM e),
  r AS (SELECT 0 AS period, l11 AS vv, CAST(0 AS DOUBLE) AS vn, l21 AS nv, l22 AS nn FROM s
    UNION ALL SELECT r.period + 1, p.b_0 * r.vv + p.b_1 * r.nv, p.b_0 * r.vn + p.b_1 * r.nn, q.b_0 * r.vv + q.b_1 * r.nv, q.b_0 * r.vn + q.b_1 * r.nn
    FROM r, fv_b p, fn_b q WHERE r.period < 4)
  """
    + " UNION ALL ".join(f"SELECT CAST(period AS INTEGER) AS period, '{x}' AS variable, '{s}' AS shock, round({x}{s}, 4) AS response FROM r" for x in "vn" for s in "vn")
)
def var_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = reg.vector_autoregression(daily(spark, sf_dir), ["v", "n"], 1, ["day"])
    made = fit.responses(5)
    rows = [(h, x, s, float(made[h, i, j])) for h in range(5) for i, x in enumerate(fit.variables) for j, s in enumerate(fit.variables)]
    return rounded(spark.createDataFrame(rows, "period int, variable string, shock string, response double"), 4, "response")


@query(f"""WITH {least_squares("f", LAGGED, "v", ["v3", "v4"])}
  SELECT day, round(b_c + b_0 * v3 + b_1 * v4, 3) AS v_trend, round(v - (b_c + b_0 * v3 + b_1 * v4), 3) AS v_detrend FROM ({LAGGED}), f_b""")
def detrend_hamilton(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reg.hamilton_detrend(daily(spark, sf_dir), "v", ["day"], p=2, h=3)
    return rounded(made.select("day", "v_trend", "v_detrend"), 3, "v_trend", "v_detrend")


@query(f"""WITH d AS (SELECT n, lead(v,1) OVER w + lead(v,2) OVER w + lead(v,3) OVER w AS y FROM {DAILY} WINDOW w AS (ORDER BY day))
  SELECT 'Intercept' AS term, round(regr_intercept(y,n),3) AS coef FROM d UNION ALL SELECT 'n', round(regr_slope(y,n),3) FROM d""")
def long_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.long_horizon(daily(spark, sf_dir), "v", "n", 3, ["day"])).select("term", "coef")


@query(f"WITH {least_squares('f', LAGGED, 'v', ['n1', 'n2', 'n3'])}, {errors('f', 3, 'hc0')} {fit_table('f', ['L1_n', 'L2_n', 'L3_n'], 3)}")
def distributed_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.distributed_lags(daily(spark, sf_dir), "v", "n", 3, ["day"]))


@query(
    f"""WITH {least_squares("a", LAGGED, "v", ["v1", "v2", "v3", "v4"])},
  u AS (SELECT day, v, v1, v - b_c - b_0 * v1 - b_1 * v2 - b_2 * v3 - b_3 * v4 AS u FROM ({LAGGED}), a_b),
  {least_squares("f", "SELECT v, v1, lag(u, 1) OVER (ORDER BY day) AS u1 FROM u", "v", ["v1", "u1"])}, {errors("f", 2, "hc0")}
  {fit_table("f", ["L1_v", "U1"], 3)}"""
)
def arma_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.arma_two_step(daily(spark, sf_dir), "v", 1, 1, ["day"]))


@query(f"WITH {leads_and_lags(1)}, {errors('f', 4, 1, 'day')} {fit_table('f', ['n', 'Dm1', 'D0', 'D1'], 3)}")
def dynamic_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_of(reg.dynamic_least_squares(daily(spark, sf_dir), "v", "n", 1, ["day"]))


GAPS = f"""SELECT day, dv, dn, lag(v - b_0 * n - b_c, 1) OVER (ORDER BY day) AS gap, lag(dv, 1) OVER (ORDER BY day) AS dv1,
  lag(dn, 1) OVER (ORDER BY day) AS dn1 FROM ({LAGGED}), (SELECT b_c, b_0 FROM f_b)"""


@query(
    f"""WITH {leads_and_lags(1)}, {least_squares("gv", GAPS, "dv", ["gap", "dv1", "dn1"])}, {least_squares("gn", GAPS, "dn", ["gap", "dv1", "dn1"])}
  SELECT 'long run' AS equation, 'n' AS term, round(b_0, 4) AS coef FROM f_b UNION ALL """
    + " UNION ALL ".join(
        f"SELECT '{e}' AS equation, '{t}' AS term, round(b_{c}, 4) AS coef FROM g{e}_b"
        for e in "vn"
        for t, c in (("Intercept", "c"), ("_gap", 0), ("L1__d0", 1), ("L1__d1", 2))
    )
)
def error_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second, beta = reg.error_correction(daily(spark, sf_dir), "v", "n", 1, ["day"], 1)
    rows = [(e, t, float(b)) for e, f in (("v", first), ("n", second)) for t, b in zip(f.terms, f.coef, strict=True)]
    return rounded(spark.createDataFrame([*rows, ("long run", "n", beta)], "equation string, term string, coef double"), 4, "coef")


@query(
    f"""WITH {VAR_FITS}, {VAR_RESIDUALS}, p AS (SELECT avg(ev * ev) / 25 AS pv, avg(en * en) / 25 AS pn FROM e),
  g AS (SELECT count(*) + 1e-8 AS a, sum(v1) AS av, sum(n1) AS an, sum(v1 * v1) + any_value(pv) AS vv, sum(v1 * n1) AS vn, sum(n1 * n1) + any_value(pn) AS nn,
    sum(v) AS yv, sum(v * v1) + any_value(pv) AS yvv, sum(v * n1) AS yvn, sum(n) AS yn, sum(n * v1) AS ynv, sum(n * n1) + any_value(pn) AS ynn
    FROM ({LAGGED}), p WHERE v1 IS NOT NULL),
  h AS (SELECT *, vv - av * av / a AS cvv, vn - av * an / a AS cvn, nn - an * an / a AS cnn, yvv - av * yv / a AS rvv, yvn - an * yv / a AS rvn,
    ynv - av * yn / a AS rnv, ynn - an * yn / a AS rnn FROM g),
  z AS (SELECT *, {", ".join(f"(cnn * r{e}v - cvn * r{e}n) / (cvv * cnn - cvn * cvn) AS b{e}v, (cvv * r{e}n - cvn * r{e}v) / (cvv * cnn - cvn * cvn) AS b{e}n" for e in "vn")} FROM h)
  """
    + " UNION ALL ".join(
        f"SELECT '{t}' AS term, '{e}' AS equation, round({x}, 4) AS coef FROM z"
        for e in "vn"
        for t, x in (("const", f"(y{e} - av * b{e}v - an * b{e}n) / a"), ("L1_v", f"b{e}v"), ("L1_n", f"b{e}n"))
    )
)
def bayesian_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = daily(spark, sf_dir)
    fit = reg.vector_autoregression(series, ["v", "n"], 1, ["day"])
    sizes = [float(x) for x in np.sqrt(np.diag(fit.sigma))]
    rows = series.withColumns({f"_l{c}": F.lag(c).over(Window.orderBy("day")) for c in ("v", "n")}).dropna()
    rows = rows.select(F.lit(1.0).alias("_x0"), F.col("_lv").alias("_x1"), F.col("_ln").alias("_x2"), F.col("v").alias("_x3"), F.col("n").alias("_x4"))
    gram = reg.symmetric_sum(rows, 5, F.lit(1.0))
    prior, precision = models.minnesota_prior(sizes, 1, 5.0)
    made = models.bayesian_var(gram[:3, :3], gram[:3, 3:], gram[3:, 3:], gram[0, 0], prior, precision, np.diag(np.square(sizes)), 4)
    out = [(t, c, float(made.coef[i, j])) for i, t in enumerate(fit.terms) for j, c in enumerate(fit.variables)]
    return rounded(spark.createDataFrame(out, "term string, equation string, coef double"), 4, "coef")


#: The daily mean of each type, with its place t from 1.
TYPED = """SELECT event_type, day, v, row_number() OVER (PARTITION BY event_type ORDER BY day) AS t
  FROM (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2)"""


@query(f"""WITH d AS ({TYPED}), size AS (SELECT event_type, count(*) AS n FROM d GROUP BY 1),
  b AS (SELECT j, CASE WHEN j = 0 THEN 2.0/3 - 1.0/6 ELSE (sin(2*pi()/3*j) - sin(2*pi()/12*j))/(pi()*j) END AS b FROM (SELECT unnest(range(0, (SELECT max(n) FROM size))) AS j)),
  c AS (SELECT j, b, sum(CASE WHEN j > 0 THEN b ELSE 0 END) OVER (ORDER BY j) AS c FROM b),
  p AS (SELECT x.event_type, x.day, x.t - 1 AS t, y.t - 1 AS s, n, y.v FROM d x JOIN d y USING (event_type) JOIN size USING (event_type)),
  w AS (SELECT p.*, CASE WHEN s = n - 1 AND t < n - 1 THEN -(0.25 + (SELECT c FROM c WHERE j = n - 2 - t)) WHEN (s = n - 1 AND t = n - 1) OR (s = 0 AND t = 0) THEN 0.25
    WHEN s = 0 THEN -(0.25 + (SELECT c FROM c WHERE j = t - 1)) ELSE (SELECT b FROM c WHERE j = abs(t - s)) END AS weight FROM p)
  SELECT event_type, day, round(sum(weight * v), 6) AS cycle FROM w GROUP BY 1, 2""")
def full_sample_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("v"))
    return rounded(models.series_filter(rows, "event_type", "day", "v", 3, 12), 6, "cycle")


@query(f"""WITH RECURSIVE d AS ({TYPED}),
  f AS (SELECT DISTINCT event_type, 0 AS t, CAST(0 AS DOUBLE) AS x, 0.5e0/(1 - 0.81e0) AS p FROM d
    UNION ALL SELECT f.event_type, f.t + 1, 0.9e0*f.x + (0.81e0*f.p + 0.5)/(0.81e0*f.p + 1.5)*(d.v - 50 - 0.9e0*f.x), (0.81e0*f.p + 0.5)/(0.81e0*f.p + 1.5)
    FROM f JOIN d ON d.event_type = f.event_type AND d.t = f.t + 1),
  s AS (SELECT f.event_type, f.t, f.x AS s FROM f JOIN (SELECT event_type, max(t) AS t FROM d GROUP BY 1) l ON l.event_type = f.event_type AND l.t = f.t
    UNION ALL SELECT f.event_type, f.t, f.x + f.p*0.9e0/(0.81e0*f.p + 0.5)*(s.s - 0.9e0*f.x) FROM s JOIN f ON f.event_type = s.event_type AND f.t = s.t - 1 WHERE f.t > 0)
  SELECT d.event_type AS event_type, d.day AS day, round(f.x, 6) AS state, round(s.s, 6) AS smooth FROM d JOIN f ON f.event_type = d.event_type AND f.t = d.t
    JOIN s ON s.event_type = d.event_type AND s.t = d.t""")
def kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = np.eye(1)
    model = kernels.StateSpace(a=0.9 * one, r=one, q=0.5 * one, z=one, h=one)
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg((F.avg("value") - 50).alias("v"))
    return rounded(kernels.kalman_filter(rows, "event_type", "day", "v", model), 6, "state", "smooth")


@query(f"""WITH RECURSIVE d AS (SELECT event_type, day, t, exp(-0.5*power((v - 40)/15.0, 2)) AS a, exp(-0.5*power((v - 60)/15.0, 2)) AS b FROM ({TYPED})),
  f AS (SELECT event_type, t, 2.0e0/3 AS ahead, 2*a/(2*a + b) AS p FROM d WHERE t = 1
    UNION ALL SELECT f.event_type, d.t, 0.2e0 + 0.7e0*f.p, (0.2e0 + 0.7e0*f.p)*d.a/((0.2e0 + 0.7e0*f.p)*d.a + (0.8e0 - 0.7e0*f.p)*d.b)
    FROM f JOIN d ON d.event_type = f.event_type AND d.t = f.t + 1),
  s AS (SELECT f.event_type, f.t, f.ahead, f.p AS s FROM f JOIN (SELECT event_type, max(t) AS t FROM d GROUP BY 1) l ON l.event_type = f.event_type AND l.t = f.t
    UNION ALL SELECT f.event_type, f.t, f.ahead, f.p*(0.9e0*s.s/s.ahead + 0.1e0*(1 - s.s)/(1 - s.ahead)) FROM s JOIN f ON f.event_type = s.event_type AND f.t = s.t - 1)
  SELECT d.event_type AS event_type, d.day AS day, CASE WHEN s.s >= 0.5 THEN 0 ELSE 1 END AS state, round(greatest(s.s, 1 - s.s), 6) AS probability
    FROM d JOIN s ON s.event_type = d.event_type AND s.t = d.t""")
def hmm_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("v"))
    made = kernels.regimes(rows, "event_type", "day", "v", np.array([[0.9, 0.1], [0.2, 0.8]]), [40.0, 60.0], 15.0)
    return rounded(made, 6, "probability")


@query()
def bootstrap_ar1(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("v"))
    series = [r["v"] for r in days.where("day is not null and v is not null").orderBy("day").collect()]
    return rounded(kernels.ar1_bias(spark, np.array(series), draws=200, seed=3), 8, "rho", "rho_ols", "rho_one_step", "rho_iterated")


@query("""WITH f AS (SELECT event_type AS i, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM events),
  c AS (SELECT i, j, count(*) AS n FROM f WHERE j IS NOT NULL GROUP BY 1,2) SELECT i, j, n, round(n/sum(n) OVER (PARTITION BY i),8) AS p FROM c""")
def markov_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(numerics.transitions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type"), 8, "p")


@query()
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", F.length(F.regexp_replace("text", "[^#*$%&]", "")).alias("symbols"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("label", F.col("quality").cast("double"))
    rows = rows.withColumn("fitted", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    model = kernels.random_forest(rows.where("fitted"), "label", ["n_chars", "symbols"], ["lang"])
    return model.transform(rows).select("doc_id", "fitted", "label", "prediction")


@query("SELECT part.p_partkey AS p_partkey, round(ln(p_size - 0.0) - ln(51.0 - p_size),8) AS l, round(0.0 + 51.0/(1+exp(-(ln(p_size) - ln(51.0 - p_size)))),6) AS back FROM part")
def bounded_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("l", numerics.logit(F.col("p_size"), 0.0, 51.0))
    return rows.select("p_partkey", F.round("l", 8).alias("l"), F.round(numerics.logistic(F.col("l"), 0.0, 51.0), 6).alias("back"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 1.0/360 ELSE (l_discount/12)/(1-power(1+l_discount/12,-360)) END,10) AS coupon FROM lineitem")
def par_coupon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(numerics.coupon(F.col("l_discount"), 12, 30), 10).alias("coupon"))


@query("""SELECT event_id, round(2*x*x-1,8) AS t2, round(4*x*x*x-3*x,8) AS t3, round(8*power(x,4)-8*x*x+1,8) AS t4
  FROM (SELECT event_id, (value-50)/500.0 AS x FROM events)""")
def chebyshev_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = numerics.chebyshev_terms((F.col("value") - 50) / 500.0, 5)
    return table(spark, sf_dir, "events").select("event_id", *(F.round(terms[i], 8).alias(f"t{i}") for i in (2, 3, 4)))


@query("SELECT c_custkey, CASE WHEN (SELECT min(c_acctbal) FROM customer) > 0 THEN round(ln(c_acctbal),8) END AS l FROM customer")
def log_if_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(numerics.log_if_positive(table(spark, sf_dir, "customer"), "c_acctbal", "l").select("c_custkey", "l"), 8, "l")
