import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.operators import regression as reg


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(7)
    pdf = pd.DataFrame({"t": range(240), "x": r.normal(size=240), "z": r.normal(size=240), "g": r.integers(0, 24, 240), "f": r.integers(0, 5, 240), "w": r.uniform(0.5, 2, 240)})
    pdf["y"] = 1 + 2 * pdf.x - pdf.z + 0.3 * pdf.g + r.normal(size=240) * (1 + pdf.x**2) ** 0.5
    return pdf, spark.createDataFrame(pdf).repartition(3).persist()


def solve(X, y, w=None):
    w = np.ones(len(y)) if w is None else w
    return np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * y))


def test_coefficients_and_robust_errors(data):
    pdf, df = data
    X = np.column_stack([np.ones(240), pdf.x, pdf.z])
    b = solve(X, pdf.y.to_numpy())
    e = pdf.y.to_numpy() - X @ b
    inv = np.linalg.inv(X.T @ X)
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    factors = {"HC0": e**2, "HC1": e**2 * 240 / 237, "HC2": e**2 / (1 - h), "HC3": e**2 / (1 - h) ** 2}
    for kind, f in factors.items():
        fit = reg.regression(df, "y ~ x + z", cov_type=kind)
        assert np.allclose(fit.coef, b)
        assert np.allclose(fit.cov, inv @ (X.T * f) @ X @ inv)
    assert fit.r2 == pytest.approx(1 - e @ e / ((pdf.y - pdf.y.mean()) ** 2).sum())


def test_hac_and_cluster_errors(data):
    pdf, df = data
    X = np.column_stack([np.ones(240), pdf.x])
    e = pdf.y.to_numpy() - X @ solve(X, pdf.y.to_numpy())
    inv, u = np.linalg.inv(X.T @ X), X * e[:, None]
    meat = u.T @ u
    for lag in (1, 2, 3):
        part = u[lag:].T @ u[:-lag]
        meat = meat + (1 - lag / 4) * (part + part.T)
    assert np.allclose(reg.regression(df, "y ~ x", hac_lags=3, order=["t"]).cov, inv @ meat @ inv)
    sums = pd.DataFrame(u).groupby(pdf.g.to_numpy()).sum().to_numpy()
    k = len(sums)
    want = inv @ (sums.T @ sums) @ inv * k / (k - 1) * 239 / 238
    assert np.allclose(reg.regression(df, "y ~ x", cluster="g").cov, want)
    with pytest.raises(ValueError):
        reg.regression(df, "y ~ x", cluster="g", hac_lags=2)


def test_weights_dummies_and_absorption_agree(data):
    pdf, df = data
    dummies = reg.regression(df, "y ~ x + z + C(g)", weight="w", cov_type="HC0")
    absorbed = reg.regression(df, "y ~ x + z - 1", weight="w", cov_type="HC0", absorb=["g"])
    assert np.allclose(dummies.coef[1:3], absorbed.coef)
    assert np.allclose(dummies.se[1:3], absorbed.se)


def test_two_way_absorption_equals_dummies(data):
    pdf, df = data
    X = np.column_stack([pdf.x, *(pdf.g == v for v in range(24)), *(pdf.f == v for v in range(1, 5))]).astype(float)
    want = np.linalg.lstsq(X, pdf.y.to_numpy(), rcond=None)[0][0]
    got = reg.regression(df, "y ~ x - 1", absorb=["g", "f"], cov_type="HC0")
    assert got.coef[0] == pytest.approx(want, rel=1e-7)


def test_absorb_small_case(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (7.0, "b"), (9.0, "b")], "x double, g string")
    assert sorted(x for (x, _) in rows(reg.absorb_effects(df, ["x"], ["g"]))) == [-1, -1, 1, 1]
    assert sorted(x for (x, _) in rows(reg.absorb_effects(df, ["x"], ["g"], restore_mean=True))) == [4, 4, 6, 6]


def test_absorb_leaves_unweighted_rows_missing(spark):
    df = spark.createDataFrame([(1.0, "a", 1.0), (3.0, "a", 1.0), (50.0, "a", 0.0), (None, "a", 1.0)], "x double, g string, w double")
    assert sorted(map(str, (x for x, _, _ in rows(reg.absorb_effects(df, ["x"], ["g"], "w"))))) == ["-1.0", "1.0", "None", "None"]


def test_singletons_once_and_until_none(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3), (3, 3)], "a int, b int")
    assert rows(reg.drop_singletons(df, ["a", "b"])) == [(3, 3), (3, 3)] or len(rows(reg.drop_singletons(df, ["a", "b"]))) >= 2
    assert rows(reg.drop_singletons(df, ["a", "b"], until_none=True)) == [(3, 3), (3, 3)]


def test_vector_autoregression(spark):
    r = np.random.default_rng(1)
    x = np.zeros((200, 2))
    for t in range(1, 200):
        x[t] = np.array([[0.5, 0.1], [0.0, 0.3]]) @ x[t - 1] + r.normal(size=2)
    df = spark.createDataFrame([(t, float(a), float(b)) for t, (a, b) in enumerate(x)], "t int, a double, b double")
    fit = reg.vector_autoregression(df, ["a", "b"], 1, ["t"])
    X = np.column_stack([np.ones(199), x[:-1]])
    assert np.allclose(fit.coef, np.linalg.lstsq(X, x[1:], rcond=None)[0])
    assert np.allclose(fit.responses(2)[1], fit.coef[1:].T @ np.linalg.cholesky(fit.sigma))


def test_local_projection_matches_a_direct_regression(data):
    pdf, df = data
    got = {h: b for h, b, _ in rows(reg.local_projection(df, "y", "x", ["t"], periods=2, shock_lags=1))}
    for h in (0, 2):
        lagged = pd.DataFrame({"y": pdf.y.shift(-h), "c": 1.0, "x": pdf.x, "l": pdf.x.shift(1), "ly": pdf.y.shift(1)}).dropna()
        assert got[h] == pytest.approx(solve(lagged[["c", "x", "l", "ly"]].to_numpy(), lagged.y.to_numpy())[1])


def test_formula_errors():
    with pytest.raises(ValueError):
        reg.Formula.parse("y")
    made = reg.Formula.parse("y ~ a:b + log(c) + C(g) - 1")
    assert (made.terms, made.effects, made.intercept) == (("a:b", "log(c)"), ("g",), False)


def test_lag_covariances_do_not_depend_on_the_runs(spark, monkeypatch):
    r = np.random.default_rng(4)
    data = [(i, float(x), float(x + y)) for i, (x, y) in enumerate(r.normal(size=(60, 2)))]
    df = spark.createDataFrame(data, "t int, x double, y double").repartition(5)
    whole = reg.regression(df, "y ~ x", hac_lags=3, order=["t"])
    monkeypatch.setattr(reg, "WINDOW_ROWS", 7)
    cut = reg.regression(df, "y ~ x", hac_lags=3, order=["t"])
    assert np.allclose(whole.cov, cut.cov, rtol=1e-12)
    assert [x.t for x in reg.numbered(df, ["t"]).orderBy("_g").collect()] == list(range(60))


@pytest.mark.parametrize("weight", [None, "w"])
def test_rows_of_a_large_group_are_not_dealt_to_one_task(spark, monkeypatch, weight):
    monkeypatch.setattr(reg, "GROUP_ROWS", 50, raising=False)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    keys = [None if i % 10 == 0 else "large" if i % 10 < 7 else f"small {i % 40}" for i in range(400)]
    pdf = pd.DataFrame({"i": range(400), "g": keys, "h": [i % 3 for i in range(400)], "x": [float(i * i % 97) for i in range(400)], "w": [1.0 + i % 4 for i in range(400)]})
    pdf["v"] = pdf.x.where(pdf.i % 11 > 0)
    df = spark.createDataFrame(pdf[["i", "g", "h", "x", "w"]]).repartition(4, "i").withColumn("v", F.when(F.col("i") % 11 > 0, F.col("x")))
    kept = pdf.dropna(subset="g")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        made = reg.demean(df, ["x", "v"], ["g"], weight)
        at = made.where("g = 'large'").select(F.spark_partition_id()).distinct().count()
        got = {r.i: (r.x, r.v) for r in made.collect()}
        two = {r.i: r.x for r in reg.demean_separate(df, ["x"], ["g", "h"]).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert at > 1
    w = kept.w if weight else 1.0 + 0 * kept.w
    for j, c in enumerate("xv"):
        over = w.groupby(kept.g).transform("sum") if weight else kept[c].notna().groupby(kept.g).transform("sum")
        expected = kept[c] - (kept[c] * w).groupby(kept.g).transform("sum") / over
        assert [got[i][j] if got[i][j] is not None else np.nan for i in kept.i] == pytest.approx(expected.tolist(), nan_ok=True)
    assert sorted(got) == kept.i.tolist()
    once = kept.x - kept.x.groupby(kept.g).transform("mean")
    assert [two[i] for i in kept.i] == pytest.approx((once - once.groupby(kept.h).transform("mean")).tolist())
