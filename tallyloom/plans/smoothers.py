"""Queries of smoothed shocks and hidden states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import smoothing
from tallyloom.functions.kernels import StateSpace
from tallyloom.plans.aggregates import rounded
from tallyloom.plans.econometrics import TYPED
from tallyloom.plans.registry import Catalogue
from tallyloom.plans.session import table

catalogue = Catalogue()
query = catalogue.query


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily mean of each type of event."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("v"))


#: A slow and a fast state whose sum is observed with noise.
SLOW_AND_FAST = StateSpace(a=np.diag([0.9, 0.5]), r=np.eye(2), q=np.diag([0.5, 1.0]), z=np.ones((1, 2)), h=np.eye(1))


@query(f"""WITH RECURSIVE d AS (SELECT event_type, day, t, v - 50 AS y FROM ({TYPED})),
  f AS (SELECT DISTINCT event_type, CAST(1 AS BIGINT) AS t, 0e0 AS x, 0e0 AS w, 0.5e0/(1 - 0.81e0) AS p, 0e0 AS c, 1/(1 - 0.25e0) AS q FROM d
    UNION ALL SELECT event_type, t + 1, 0.9e0*(x + g*e), 0.5e0*(w + h*e), 0.81e0*(p - g*(p + c)) + 0.5, 0.45e0*(c - g*(c + q)), 0.25e0*(q - h*(c + q)) + 1
    FROM (SELECT f.*, (p + c)/(p + 2*c + q + 1) AS g, (c + q)/(p + 2*c + q + 1) AS h, d.y - x - w AS e FROM f JOIN d ON d.event_type = f.event_type AND d.t = f.t)),
  s AS (SELECT f.event_type, f.t, (p + c)/(p + 2*c + q + 1) AS g, (c + q)/(p + 2*c + q + 1) AS h, (d.y - x - w)/(p + 2*c + q + 1) AS u FROM f JOIN d ON d.event_type = f.event_type AND d.t = f.t),
  r AS (SELECT event_type, t, u AS a, u AS b FROM s WHERE t = (SELECT max(t) FROM d WHERE d.event_type = s.event_type)
    UNION ALL SELECT s.event_type, s.t, s.u + 0.9e0*(1 - s.g)*r.a - 0.5e0*s.h*r.b, s.u - 0.9e0*s.g*r.a + 0.5e0*(1 - s.h)*r.b
    FROM r JOIN s ON s.event_type = r.event_type AND s.t = r.t - 1),
  c AS (SELECT event_type, t, 0.5*a AS m, b AS n, 0.9e0*(0.5e0/(1 - 0.81e0)*0.9e0*a) AS l, 0.5e0*(1/(1 - 0.25e0)*0.5e0*b) AS k FROM r WHERE t = 1
    UNION ALL SELECT r.event_type, r.t, 0.9e0*c.m + 0.5*r.a, 0.5e0*c.n + r.b, 0.9e0*c.l, 0.5e0*c.k FROM c JOIN r ON r.event_type = c.event_type AND r.t = c.t + 1)
  SELECT d.event_type AS event_type, day, round(0.5*a, 6) AS shock_slow, round(b, 6) AS shock_fast, round(m, 6) AS part_y_slow, round(n, 6) AS part_y_fast,
    round(l + k, 6) AS base_y, round(y - m - n - l - k, 6) AS noise_y FROM d JOIN r ON r.event_type = d.event_type AND r.t = d.t JOIN c ON c.event_type = d.event_type AND c.t = d.t""")
def shock_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed(spark, sf_dir).withColumn("y", F.col("v") - 50)
    made = smoothing.smooth_shocks(rows, "event_type", "day", ["y"], SLOW_AND_FAST, ["slow", "fast"])
    return rounded(made, 6, "shock_slow", "shock_fast", "part_y_slow", "part_y_fast", "base_y", "noise_y")


@query(f"""WITH RECURSIVE d AS (SELECT event_type, day, t, exp(-0.5*power((v - 40)/15.0, 2)) AS a, exp(-0.5*power((v - 60)/15.0, 2)) AS b FROM ({TYPED})),
  f AS (SELECT event_type, t, 2.0e0/3 AS ahead, 2*a/(2*a + b) AS p FROM d WHERE t = 1
    UNION ALL SELECT f.event_type, d.t, 0.2e0 + 0.7e0*f.p, (0.2e0 + 0.7e0*f.p)*d.a/((0.2e0 + 0.7e0*f.p)*d.a + (0.8e0 - 0.7e0*f.p)*d.b)
    FROM f JOIN d ON d.event_type = f.event_type AND d.t = f.t + 1),
  s AS (SELECT f.event_type, f.t, f.ahead, f.p, f.p AS s FROM f JOIN (SELECT event_type, max(t) AS t FROM d GROUP BY 1) l ON l.event_type = f.event_type AND l.t = f.t
    UNION ALL SELECT f.event_type, f.t, f.ahead, f.p, f.p*(0.9e0*s.s/s.ahead + 0.1e0*(1 - s.s)/(1 - s.ahead)) FROM s JOIN f ON f.event_type = s.event_type AND f.t = s.t - 1),
  q AS (SELECT *, unnest([0.25e0, 0.75e0]) AS level FROM s),
  m AS (SELECT event_type, t, max(CASE WHEN level < 0.5 THEN x END) AS q25, max(CASE WHEN level > 0.5 THEN x END) AS q75
    FROM (SELECT *, CASE WHEN level <= s THEN 40 ELSE 40 + 20*(level - s)/(1 - s) END AS x FROM q) GROUP BY 1, 2)
  SELECT d.event_type AS event_type, day, round(60 - 20*p, 6) AS filtered, round(60 - 20*s, 6) AS smoothed, round(q25, 6) AS q25, round(q75, 6) AS q75
    FROM d JOIN s ON s.event_type = d.event_type AND s.t = d.t JOIN m ON m.event_type = d.event_type AND m.t = d.t""")
def hidden_state_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = smoothing.regime_values(typed(spark, sf_dir), "event_type", "day", "v", np.array([[0.9, 0.1], [0.2, 0.8]]), [40.0, 60.0], 15.0, [0.25, 0.75])
    return rounded(made, 6, "filtered", "smoothed", "q25", "q75")
