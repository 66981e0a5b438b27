"""Queries of systems of equations, error correction, long horizons and moment estimators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import hierarchical
from tallyloom.operators import regression as reg
from tallyloom.operators import systems
from tallyloom.plans.aggregates import rounded
from tallyloom.plans.econometrics import LAGGED, VAR_FITS, VAR_RESIDUALS
from tallyloom.plans.least_squares import least_squares
from tallyloom.plans.registry import Catalogue
from tallyloom.plans.session import table
from tallyloom.plans.timeseries import daily

catalogue = Catalogue()
query = catalogue.query

ITEMS = "SELECT CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_discount AS DOUBLE) AS discount, CAST(l_quantity AS DOUBLE) AS q, CAST(l_tax AS DOUBLE) AS tax FROM lineitem"


@query(f"""WITH {least_squares("p", ITEMS, "price", ["q", "tax"])}, {least_squares("d", ITEMS, "discount", ["q", "tax"])},
  x AS (SELECT price - p.b_c - p.b_0*q - p.b_1*tax AS e, discount - d.b_c - d.b_0*q - d.b_1*tax AS f, (q - p.m_0)*p.v_0_0 + (tax - p.m_1)*p.v_0_1 AS gq,
    (q - p.m_0)*p.v_1_0 + (tax - p.m_1)*p.v_1_1 AS gt, p.b_1 AS bp, d.b_1 AS bd, p.b_0 AS qp, d.b_0 AS qd FROM ({ITEMS}), p_b p, d_b d),
  v AS (SELECT any_value(bp) AS bp, any_value(bd) AS bd, any_value(qp) AS qp, any_value(qd) AS qd, sum(gt*gt*e*e) AS pp, sum(gt*gt*e*f) AS pd, sum(gt*gt*f*f) AS dd,
    sqrt(sum(gq*gq*e*e)) AS sp, sqrt(sum(gq*gq*f*f)) AS sd, sqrt(sum((gq*e + gt*f)*(gq*e + gt*f))) AS sc, avg(e*e) AS see, avg(e*f) AS sef, avg(f*f) AS sff FROM x)
  SELECT 'tax moves neither' AS test, round((bp*bp*dd - 2*bp*bd*pd + bd*bd*pp)/(pp*dd - pd*pd), 4) AS value, round(exp(-0.5*(bp*bp*dd - 2*bp*bd*pd + bd*bd*pp)/(pp*dd - pd*pd)), 6) AS extra FROM v
  UNION ALL SELECT 'quantity on price', round(qp, 3), round(sp, 3) FROM v UNION ALL SELECT 'quantity on discount', round(qd, 7), round(sd, 7) FROM v
  UNION ALL SELECT 'quantity on price plus tax on discount', round(qp + bd, 3), round(sc, 3) FROM v
  UNION ALL SELECT 'residual correlation', round(sef/sqrt(see*sff), 6), NULL FROM v""")
def system_wald(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    price, discount, q, tax = "l_extendedprice", "l_discount", "l_quantity", "l_tax"
    fit = systems.system_regression(rows, [price, discount], [q, tax])
    statistic, _, p = fit.wald([{(tax, price): 1.0}, {(tax, discount): 1.0}])
    both = fit.combination({(q, price): 1.0, (tax, discount): 1.0})
    at = fit.terms.index(q)
    out = [
        ("tax moves neither", round(statistic, 4), round(p, 6)),
        *((f"quantity on {n}", round(float(fit.coef[at, j]), d), round(float(fit.se[at, j]), d)) for j, (n, d) in enumerate((("price", 3), ("discount", 7)))),
        ("quantity on price plus tax on discount", *(round(x, 3) for x in both)),
        ("residual correlation", round(float(fit.sigma[0, 1] / (fit.sigma[0, 0] * fit.sigma[1, 1]) ** 0.5), 6), None),
    ]
    return spark.createDataFrame(out, "test string, value double, extra double")


#: The daily series with a third one, the people seen.
THREE = "(SELECT CAST(ts AS DATE) AS day, sum(value) AS v, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT user_id) AS DOUBLE) AS u FROM events GROUP BY 1)"
NAMES = ("v", "n", "u")


def three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen people are counted from distinct (day, user), which both aggregations can sum in part."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), "user_id").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return rows.groupBy("day").agg(F.sum("v").alias("v"), F.sum("n").cast("double").alias("n"), F.count("user_id").cast("double").alias("u"))


CHANGES = f"SELECT day, v, n, u, {', '.join(f'{c} - lag({c}, 1) OVER w AS d{c}' for c in NAMES)} FROM {THREE} WINDOW w AS (ORDER BY day)"
AROUND = f"SELECT *, lag(du, -1) OVER w AS a, lag(du, 1) OVER w AS c FROM ({CHANGES}) WINDOW w AS (ORDER BY day)"
TWO_GAPS = f"""SELECT day, dv, dn, du, lag(v - rv.b_0*u - rv.b_c, 1) OVER w AS g, lag(n - rn.b_0*u - rn.b_c, 1) OVER w AS h, {", ".join(f"lag(d{c}, 1) OVER w AS l{c}" for c in NAMES)}
  FROM ({CHANGES}), (SELECT b_0, b_c FROM rv_b) rv, (SELECT b_0, b_c FROM rn_b) rn WINDOW w AS (ORDER BY day)"""
EQUATIONS = ",\n  ".join(least_squares(f"e{c}", TWO_GAPS, f"d{c}", ["g", "h", "lv", "ln", "lu"]) for c in NAMES)


@query(
    f"""WITH RECURSIVE {least_squares("rv", AROUND, "v", ["u", "a", "du", "c"])}, {least_squares("rn", AROUND, "n", ["u", "a", "du", "c"])}, {EQUATIONS},
  r AS (SELECT s AS shock, 0 AS period, (s = 'v')::DOUBLE AS lv, (s = 'n')::DOUBLE AS ln, (s = 'u')::DOUBLE AS lu, (s = 'v')::DOUBLE AS dv, (s = 'n')::DOUBLE AS dn, (s = 'u')::DOUBLE AS du,
      (s = 'v')::DOUBLE - rv.b_0*(s = 'u')::DOUBLE AS g, (s = 'n')::DOUBLE - rn.b_0*(s = 'u')::DOUBLE AS h FROM (SELECT unnest(['v', 'n', 'u']) AS s), rv_b rv, rn_b rn
    UNION ALL SELECT shock, period + 1, lv + mv, ln + mn, lu + mu, mv, mn, mu, g + mv - p*mu, h + mn - q*mu FROM (
      SELECT r.*, rv.b_0 AS p, rn.b_0 AS q, {", ".join(f"e{c}.b_0*g + e{c}.b_1*h + e{c}.b_2*dv + e{c}.b_3*dn + e{c}.b_4*du AS m{c}" for c in NAMES)}
      FROM r, rv_b rv, rn_b rn, {", ".join(f"e{c}_b e{c}" for c in NAMES)} WHERE period < 5))
  """
    + " UNION ALL ".join(f"SELECT CAST(period AS INTEGER) AS period, '{c}' AS variable, shock, round(l{c}, 4) AS response FROM r" for c in NAMES)
)
def error_correction_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = systems.error_correction_system(three(spark, sf_dir), NAMES, [("v", ["u"]), ("n", ["u"])], 1, ["day"], 1)
    got = made.responses(6, np.eye(3))
    rows = [(t, x, s, float(got[t, i, j])) for t in range(6) for i, x in enumerate(NAMES) for j, s in enumerate(NAMES)]
    return rounded(spark.createDataFrame(rows, "period int, variable string, shock string, response double"), 4, "response")


@query(f"""WITH RECURSIVE {VAR_FITS}, {VAR_RESIDUALS}, q AS (SELECT avg(ev*ev) AS vv, avg(ev*en) AS vn, avg(en*en) AS nn FROM e),
  c AS (SELECT p.b_0 AS a, p.b_1 AS b, f.b_0 AS c, f.b_1 AS d, vv, vn, nn FROM q, fv_b p, fn_b f),
  w AS (SELECT 0 AS j, CAST(1 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS r, CAST(1 AS DOUBLE) AS s
    UNION ALL SELECT j + 1, a*p + b*r, a*q + b*s, c*p + d*r, c*q + d*s FROM w, c WHERE j < 400),
  g AS (SELECT sum(p*p*vv + 2*p*q*vn + q*q*nn) AS gvv, sum(p*r*vv + (p*s + q*r)*vn + q*s*nn) AS gvn, sum(r*r*vv + 2*r*s*vn + s*s*nn) AS gnn FROM w, c),
  t AS (SELECT sum(p*gvn + q*gnn) FILTER (j > 0) AS ahead, sum((5 - j)*(p*gvv + q*gvn)*2) FILTER (j BETWEEN 1 AND 4) + 5*any_value(gvv) AS kvv,
    sum((5 - j)*((p*gvn + q*gnn) + (r*gvv + s*gvn))) FILTER (j BETWEEN 1 AND 4) + 5*any_value(gvn) AS kvn,
    sum((5 - j)*(r*gvn + s*gnn)*2) FILTER (j BETWEEN 1 AND 4) + 5*any_value(gnn) AS knn, any_value(gvv) AS gvv, any_value(gnn) AS gnn FROM w, g WHERE j <= 5)
  SELECT 'predictive' AS what, round(ahead/gnn, 6) AS value, round(ahead*ahead/(kvv*gnn), 8) AS r2 FROM t
  UNION ALL SELECT 'contemporaneous', round(kvn/knn, 6), round(kvn*kvn/(knn*kvv), 8) FROM t
  UNION ALL SELECT 'variance ratio v', round(kvv/(5*gvv), 6), NULL FROM t UNION ALL SELECT 'variance ratio n', round(knn/(5*gnn), 6), NULL FROM t""")
def long_horizon_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = systems.long_horizon_system(reg.vector_autoregression(daily(spark, sf_dir), ["v", "n"], 1, ["day"]), 5)
    (_, ahead, ahead_r2), (coef, r2) = made.predictive()[0], made.contemporaneous()
    rows = [("predictive", round(ahead, 6), round(ahead_r2, 8)), ("contemporaneous", round(float(coef[0]), 6), round(r2, 8))]
    rows += [(f"variance ratio {x}", round(v, 6), None) for x, v in made.variance_ratios().items()]
    return spark.createDataFrame(rows, "what string, value double, r2 double")


@query(f"""WITH {VAR_FITS}, {VAR_RESIDUALS}, p AS (SELECT avg(ev * ev) AS sv, avg(en * en) AS sn FROM e),
  t AS (SELECT unnest([0.05e0, 0.2e0, 0.5e0, 2.0e0]) AS tightness), q AS (SELECT tightness, sv, sn, sv/(tightness*tightness) AS pv, sn/(tightness*tightness) AS pn FROM p, t),
  g AS (SELECT tightness, count(*) AS k, count(*) + 1e-6 AS a, sum(v1) AS av, sum(n1) AS an, sum(v1*v1) + any_value(pv) AS vv, sum(v1*n1) AS vn, sum(n1*n1) + any_value(pn) AS nn,
    sum(v) AS yv, sum(v*v1) + any_value(pv) AS yvv, sum(v*n1) AS yvn, sum(n) AS yn, sum(n*v1) AS ynv, sum(n*n1) + any_value(pn) AS ynn,
    sum(v*v) + any_value(sv + pv) AS svv, sum(v*n) AS svn, sum(n*n) + any_value(sn + pn) AS snn, any_value(pv) AS pv, any_value(pn) AS pn, any_value(sv) AS sv, any_value(sn) AS sn
    FROM ({LAGGED}), q WHERE v1 IS NOT NULL GROUP BY tightness),
  h AS (SELECT *, vv - av*av/a AS cvv, vn - av*an/a AS cvn, nn - an*an/a AS cnn, yvv - av*yv/a AS rvv, yvn - an*yv/a AS rvn, ynv - av*yn/a AS rnv, ynn - an*yn/a AS rnn FROM g),
  z AS (SELECT *, cvv*cnn - cvn*cvn AS det, svv - yv*yv/a - (rvv*rvv*cnn - 2*rvv*rvn*cvn + rvn*rvn*cvv)/(cvv*cnn - cvn*cvn) AS fvv,
    svn - yv*yn/a - (rvv*rnv*cnn - (rvv*rnn + rvn*rnv)*cvn + rvn*rnn*cvv)/(cvv*cnn - cvn*cvn) AS fvn,
    snn - yn*yn/a - (rnv*rnv*cnn - 2*rnv*rnn*cvn + rnn*rnn*cvv)/(cvv*cnn - cvn*cvn) AS fnn FROM h)
  SELECT tightness, round(-k*ln(pi()) + lgamma((4 + k)/2e0) + lgamma((3 + k)/2e0) - lgamma(2e0) - lgamma(1.5e0) + ln(1e-6*pv*pn) - ln(a*det) + 2*ln(sv*sn)
    - (4 + k)/2e0*ln(fvv*fnn - fvn*fvn), 3) AS log_marginal FROM z""")
def prior_tightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = reg.var_moments(daily(spark, sf_dir), ["v", "n"], 1, ["day"])
    k = len(moments.gram) - 2
    coef = np.linalg.solve(moments.gram[:k, :k], moments.gram[:k, k:])
    scales = np.diag(moments.gram[k:, k:] - coef.T @ moments.gram[:k, k:]) / moments.n
    rows = [(t, round(float(hierarchical.log_marginal(moments, hierarchical.VarPrior(t, scales))), 3)) for t in (0.05, 0.2, 0.5, 2.0)]
    return spark.createDataFrame(rows, "tightness double, log_marginal double")


@query("""WITH d AS (SELECT CAST(l_extendedprice AS DOUBLE)/1000 AS y, CAST(l_quantity AS DOUBLE) AS q, 1 + floor(CAST(l_quantity AS DOUBLE)/10) AS z FROM lineitem),
  m AS (SELECT count(*) AS n, avg(q) AS a, avg(z*q) AS b, avg(y) AS c, avg(z*y) AS d FROM d), one AS (SELECT (a*c + b*d)/(a*a + b*b) AS p FROM m),
  s AS (SELECT avg((y - p*q)*(y - p*q)) AS s1, avg(z*(y - p*q)*(y - p*q)) AS s2, avg(z*z*(y - p*q)*(y - p*q)) AS s3 FROM d, one),
  two AS (SELECT (a*(s3*c - s2*d) + b*(s1*d - s2*c))/(a*(s3*a - s2*b) + b*(s1*b - s2*a)) AS p, s1, s2, s3 FROM m, s),
  w AS (SELECT avg((y - p*q)*(y - p*q)) AS t1, avg(z*(y - p*q)*(y - p*q)) AS t2, avg(z*z*(y - p*q)*(y - p*q)) AS t3 FROM d, two),
  f AS (SELECT n, p, c - p*a AS g, d - p*b AS h, t1, t2, t3, s3*a - s2*b AS u, s1*b - s2*a AS v, a, b FROM m, two, w)
  SELECT round(p, 8) AS slope, round(sqrt((u*u*t1 + 2*u*v*t2 + v*v*t3)/power(a*u + b*v, 2)/n), 9) AS se, round(n*(g*g*t3 - 2*g*h*t2 + h*h*t1)/(t1*t3 - t2*t2), 4) AS j_statistic FROM f""")
def moment_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice").cast("double") / 1000).alias("y"), F.col("l_quantity").cast("double").alias("q"))
    z = 1 + F.floor(F.col("q") / 10)
    fit = systems.moment_estimator(
        rows,
        [0.0],
        lambda p: [F.col("y") - float(p[0]) * F.col("q"), z * (F.col("y") - float(p[0]) * F.col("q"))],
        lambda p: [[-F.col("q")], [-z * F.col("q")]],
    )
    return spark.createDataFrame([(round(float(fit.params[0]), 8), round(float(fit.cov[0, 0] ** 0.5), 9), round(fit.j_statistic, 4))], "slope double, se double, j_statistic double")
