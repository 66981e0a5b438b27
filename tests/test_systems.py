import math

import numpy as np
import pytest
from conftest import rows

from tallyloom.functions import smoothing
from tallyloom.functions.kernels import StateSpace, hidden_markov
from tallyloom.operators import regression as reg
from tallyloom.operators import systems
from pyspark.sql import functions as F


def test_chi_square_tails():
    assert systems.upper_chi_square(3.841458820694124, 1) == pytest.approx(0.05)
    assert systems.upper_chi_square(2 * math.log(20), 2) == pytest.approx(0.05)
    assert systems.upper_chi_square(18.307038053275146, 10) == pytest.approx(0.05)
    assert systems.upper_chi_square(0.0, 3) == 1.0 and systems.upper_chi_square(4.0, 4) == pytest.approx(math.exp(-2) * 3)


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(1)
    n = 300
    x, z = r.normal(size=n) + 5, r.normal(size=n)
    e = r.normal(size=(n, 2)) @ np.array([[1.0, 0.6], [0, 0.8]]) * (1 + 0.3 * np.abs(z))[:, None]
    y = np.column_stack([2 + x - z, -1 + 0.5 * x + 3 * z]) + e
    pdf = [(i, *map(float, row)) for i, row in enumerate(np.column_stack([y, x, z]))]
    return spark.createDataFrame([*pdf, (n, None, 1.0, 1.0, 1.0), (n + 1, float("nan"), 1.0, 1.0, 1.0)], "t long, y1 double, y2 double, x double, z double"), y, np.column_stack([np.ones(n), x, z])


def test_systems_of_equations(sample):
    df, y, x = sample
    n = len(y)
    fit = systems.system_regression(df, ["y1", "y2"], ["x", "z"])
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ coef
    inverse = np.linalg.inv(x.T @ x)
    scores = np.hstack([e[:, [j]] * x for j in range(2)])
    bread = np.kron(np.eye(2), inverse)
    assert fit.n == n and np.allclose(fit.coef, coef) and np.allclose(fit.sigma, e.T @ e / n)
    assert np.allclose(fit.cov, bread @ scores.T @ scores @ bread)
    plain = systems.system_regression(df, ["y1", "y2"], ["x", "z"], robust=False)
    assert np.allclose(plain.cov, np.kron(e.T @ e / n, inverse))
    value, se = fit.combination({("x", "y1"): 1.0, ("x", "y2"): -2.0})
    a = np.array([0, 1, 0, 0, -2, 0.0])
    assert value == pytest.approx(coef[1, 0] - 2 * coef[1, 1]) and se == pytest.approx(math.sqrt(a @ fit.cov @ a))
    statistic, degrees, p = fit.wald([{("z", "y1"): 1.0}, {("z", "y2"): 1.0}], [-1.0, 3.0])
    gap = coef[2] - [-1, 3]
    assert degrees == 2 and statistic == pytest.approx(gap @ np.linalg.solve(fit.cov[np.ix_([2, 5], [2, 5])], gap)) and p == pytest.approx(math.exp(-statistic / 2))
    spread = np.linalg.slogdet(fit.sigma)[1]
    assert fit.criteria()["bic"] == pytest.approx(spread + math.log(n) * 6 / n)
    with pytest.raises(ValueError, match="complete rows"):
        systems.system_regression(df.where("t < 2"), ["y1"], ["x", "z"])


def test_sums_of_coefficients(sample):
    df, _, _ = sample
    fit = reg.regression(df, "y1 ~ x + z", cov_type="HC0")
    got, se = systems.sum_of_coefficients(fit, ["x", "z"])
    assert got == pytest.approx(fit.coef[1] + fit.coef[2]) and se == pytest.approx(math.sqrt(fit.cov[1:, 1:].sum()))


def test_error_correction_with_two_relations(spark):
    r = np.random.default_rng(3)
    n = 2000
    u = np.cumsum(r.normal(size=n))
    v = 2 * u + 1 + r.normal(size=n)
    w = -u + 0.3 + r.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(zip(u, v, w, strict=True))], "t long, u double, v double, w double")
    made = systems.error_correction_system(df, ["v", "w", "u"], [("v", ["u"]), ("w", ["u"])], 2, ["t"], 2)
    assert np.allclose(made.relations, [[1, 0, -2], [0, 1, 1]], atol=0.02) and np.allclose(made.levels, [1, 0.3], atol=0.3)
    assert made.companion().shape == (8, 8)
    got = made.responses(60)
    assert np.allclose(got[0], np.linalg.cholesky(made.fit.sigma))
    assert np.allclose(made.relations @ got[-1], 0, atol=1e-3)  # the gaps close
    # against the recursion written out
    d = np.zeros((70, 3, 3))
    gap, d[2] = made.relations @ got[0], got[0]
    pull, (one, two) = made.fit.coef[1:3].T, (made.fit.coef[3:6].T, made.fit.coef[6:9].T)
    for t in range(3, 12):
        d[t] = pull @ gap + one @ d[t - 1] + two @ d[t - 2]
        gap = gap + made.relations @ d[t]
        assert np.allclose(got[t - 2], d[: t + 1].sum(axis=0))


def test_long_horizons_of_an_autoregression():
    a, sigma = np.array([[0.5, 0.2], [-0.1, 0.3]]), np.array([[1.0, 0.3], [0.3, 2.0]])
    fit = reg.VectorFit(["y", "x"], ["const", "L1_y", "L1_x"], np.vstack([[0, 0], a.T]), sigma, 100)
    made = systems.long_horizon_system(fit, 4)
    now = sum(np.linalg.matrix_power(a, j) @ sigma @ np.linalg.matrix_power(a, j).T for j in range(200))
    assert np.allclose(made.now, now)
    lagged = [np.linalg.matrix_power(a, j) @ now for j in range(5)]
    sums = 4 * now + sum((4 - j) * (lagged[j] + lagged[j].T) for j in range(1, 4))
    assert np.allclose(made.sums, sums) and np.allclose(made.ahead, sum(lagged[1:]))
    (x, b, r2), = made.predictive()
    assert x == "x" and b == pytest.approx(made.ahead[0, 1] / now[1, 1]) and r2 == pytest.approx(made.ahead[0, 1] ** 2 / sums[0, 0] / now[1, 1])
    coef, share = made.contemporaneous()
    assert coef[0] == pytest.approx(sums[0, 1] / sums[1, 1]) and made.orthogonal()[0][1:] == pytest.approx((coef[0], share))
    assert made.variance_ratios()["y"] == pytest.approx(sums[0, 0] / 4 / now[0, 0])
    with pytest.raises(ArithmeticError, match="stable"):
        systems.long_horizon_system(reg.VectorFit(["y", "x"], fit.terms, np.vstack([[0, 0], 1.1 * np.eye(2)]), sigma, 100), 4)


def test_sums_on_sums(sample):
    df, y, x = sample
    fit = systems.sum_on_sums(df.where("t < 300"), "y1", ["x"], 3, ["t"])
    s = lambda v: v[2:] + v[1:-1] + v[:-2]
    assert fit.n == 298 and np.allclose(fit.coef, np.polyfit(s(x[:, 1]), s(y[:, 0]), 1)[::-1])


def test_moments_of_linear_instruments_are_the_closed_form(spark):
    r = np.random.default_rng(4)
    n = 500
    z = r.normal(size=(n, 2))
    u = r.normal(size=n)
    x = z @ [1.0, -0.5] + u + r.normal(size=n)
    y = 1 + 2 * x + u
    df = spark.createDataFrame([tuple(map(float, row)) for row in np.column_stack([y, x, z])], "y double, x double, z1 double, z2 double")
    error = lambda p: F.col("y") - float(p[0]) - float(p[1]) * F.col("x")
    given = [F.lit(1.0), F.col("z1"), F.col("z2")]
    moments = lambda p: [k * error(p) for k in given]
    fit = systems.moment_estimator(df, [0.0, 0.0], moments, lambda p: [[-k, -k * F.col("x")] for k in given])
    zz, xx = np.column_stack([np.ones(n), z]), np.column_stack([np.ones(n), x])
    d, c, w = zz.T @ xx / n, zz.T @ y / n, np.eye(3)
    for _ in range(2):
        b = np.linalg.solve(d.T @ w @ d, d.T @ w @ c)
        e = y - xx @ b
        s = (zz * e[:, None]).T @ (zz * e[:, None]) / n
        last, w = w, np.linalg.inv(s)
    bread = np.linalg.inv(d.T @ last @ d)
    assert np.allclose(fit.params, b, atol=1e-8) and np.allclose(fit.cov, bread @ d.T @ last @ s @ last @ d @ bread / n, rtol=1e-6)
    g = c - d @ b
    assert fit.j_statistic == pytest.approx(n * g @ w @ g, rel=1e-5) and fit.j_p == pytest.approx(math.erfc(math.sqrt(fit.j_statistic / 2)), rel=1e-6)
    numeric = systems.moment_estimator(df, [0.0, 0.0], moments)
    assert np.allclose(numeric.params, fit.params, atol=1e-6)


def test_nonlinear_moments_with_second_derivatives(spark):
    r = np.random.default_rng(5)
    x = r.uniform(0, 1, 400)
    y = np.exp(0.3 + 0.8 * x) + r.normal(size=400) * 0.1
    df = spark.createDataFrame([tuple(map(float, p)) for p in zip(y, x, strict=True)], "y double, x double")
    given = [F.lit(1.0), F.col("x")]
    fitted = lambda p: F.exp(F.lit(float(p[0])) + F.lit(float(p[1])) * F.col("x"))
    fit = systems.moment_estimator(
        df, [0.0, 0.0], lambda p: [k * (F.col("y") - fitted(p)) for k in given], lambda p: [[-k * j * fitted(p) for j in given] for k in given],
        lambda p: [[[-k * i * j * fitted(p) for j in given] for i in given] for k in given], rounds=1,
    )
    xx, b = np.column_stack([np.ones(400), x]), np.zeros(2)
    for _ in range(50):
        b = b + np.linalg.solve((xx * np.exp(xx @ b)[:, None]).T @ xx, xx.T @ (y - np.exp(xx @ b)))
    assert np.allclose(fit.params, b, atol=1e-6) and fit.j_p == 1.0
    with pytest.raises(ValueError, match="no rows"):
        systems.moment_estimator(df.where("x > 2"), [0.0, 0.0], lambda p: [k * (F.col("y") - fitted(p)) for k in given])


# smoothers

MODEL = StateSpace(a=np.array([[0.8, 0.1], [0.0, 0.5]]), r=np.array([[1.0, 0.2], [0.0, 1.0]]), q=np.diag([0.5, 1.0]), z=np.array([[1.0, 0.5], [0.0, 1.0]]), h=np.diag([0.3, 0.4]))


def stacked(y):
    """Joint moments of (start, shocks) given y, by one large normal distribution."""
    n, k, e = len(y), 2, 2
    size = k + e * n
    prior = np.zeros((size, size))
    prior[:k, :k] = MODEL.stationary_variance()
    for t in range(n):
        prior[k + e * t : k + e * t + e, k + e * t : k + e * t + e] = MODEL.q
    states, x = [], np.hstack([np.eye(k), np.zeros((k, e * n))])
    for t in range(n):
        x = MODEL.a @ x
        x[:, k + e * t : k + e * t + e] += MODEL.r
        states.append(x)
    load = np.vstack([MODEL.z @ s for s in states])
    seen = np.isfinite(y.ravel())
    load, noise = load[seen], np.kron(np.eye(n), MODEL.h)[np.ix_(seen, seen)]
    gain = prior @ load.T @ np.linalg.inv(load @ prior @ load.T + noise)
    return gain @ y.ravel()[seen], prior - gain @ load @ prior, states


def series():
    y = np.random.default_rng(6).normal(size=(7, 2)) * 2
    y[2, 0] = y[4, 1] = np.nan
    y[5] = np.nan
    return y


def test_smoothed_shocks_are_the_conditional_means():
    y = series()
    mean, _, states = stacked(y)
    told = smoothing.disturbances(MODEL, y)
    assert np.allclose(told.start, mean[:2]) and np.allclose(told.shocks.ravel(), mean[2:])
    assert np.allclose(told.states, [s @ mean for s in states]) and np.allclose(told.states, MODEL.smoothed(y))
    parts, base = smoothing.decomposed(MODEL, told.shocks, told.start)
    assert np.allclose(parts.sum(axis=0) + base, told.states)
    late, held = smoothing.decomposed(MODEL, told.shocks, told.start, begin=3)
    assert np.allclose(late.sum(axis=0) + held, told.states) and np.allclose(late[:, :3], 0) and np.allclose(held[:3], told.states[:3])


def test_joint_draws_have_the_smoothers_moments(spark):
    y = series()
    mean, cov, _ = stacked(y)
    r = np.random.default_rng(7)
    drawn = [smoothing.draw_disturbances(MODEL, y, r) for _ in range(4000)]
    flat = np.array([np.r_[d.start, d.shocks.ravel()] for d in drawn])
    assert np.abs(flat.mean(axis=0) - mean).max() < 0.08 and np.abs(np.cov(flat.T) - cov).max() < 0.1
    d = drawn[0]
    assert np.allclose(smoothing.driven(MODEL, d.shocks, d.start), d.states)
    df = spark.createDataFrame([(k, t, *(None if np.isnan(v) else float(v) for v in row)) for k in "ab" for t, row in enumerate(y)], "k string, t long, p double, q double")
    first, again = (smoothing.draw_states(x, "k", "t", ["p", "q"], MODEL, draws=60, seed=1) for x in (df, df.repartition(3)))
    assert first.count() == 2 * 7 * 60 and rows(first, "k", "t", "draw") == rows(again, "k", "t", "draw")
    assert first.where("k = 'a' and draw = 0").select("state_0").collect() != first.where("k = 'b' and draw = 0").select("state_0").collect()
    means = first.groupBy("k", "t").agg(F.avg("state_0").alias("m")).orderBy("k", "t").collect()
    assert np.allclose([m["m"] for m in means[:7]], smoothing.disturbances(MODEL, y).states[:, 0], atol=0.6)


def test_parts_add_up_in_a_table(spark):
    y = series()
    df = spark.createDataFrame([("a", t, *(None if np.isnan(v) else float(v) for v in row)) for t, row in enumerate(y)], "k string, t long, p double, q double")
    made = smoothing.smooth_shocks(df, "k", "t", ["p", "q"], MODEL, ["one", "two"]).orderBy("t").toPandas()
    total = made["part_p_one"] + made["part_p_two"] + made["base_p"] + made["noise_p"]
    assert np.allclose(total.dropna(), y[np.isfinite(y[:, 0]), 0]) and total.isna().sum() == 2


# hidden states


def test_hidden_state_draws_and_quantiles(spark):
    p, means = np.array([[0.9, 0.1, 0.0], [0.2, 0.7, 0.1], [0.0, 0.3, 0.7]]), [0.0, 1.0, 3.0]
    y = np.array([0.1, 1.2, 2.8, np.nan, 0.9])
    forward, smooth, _ = hidden_markov(p, smoothing.normal_log_density(y, means, 0.8))
    paths = smoothing.sampled_regimes(p, forward, np.random.default_rng(8), 20_000)
    shares = np.array([[(row == s).mean() for s in range(3)] for row in paths])
    assert np.abs(shares - smooth).max() < 0.015
    assert not ((paths[:-1] == 0) & (paths[1:] == 2)).any()  # a move that cannot be
    df = spark.createDataFrame([("a", t, None if np.isnan(v) else float(v)) for t, v in enumerate(y)], "k string, t long, v double")
    got = smoothing.regime_values(df, "k", "t", "v", p, means, 0.8, [0.1, 0.9]).orderBy("t").toPandas()
    assert np.allclose(got["smoothed"], smooth @ means) and np.allclose(got["q90"], [np.interp(0.9, np.cumsum(s), means) for s in smooth])
    drawn = smoothing.draw_regimes(df, "k", "t", "v", p, means, 0.8, draws=120, seed=2)
    assert drawn.count() == 5 * 120 and rows(drawn, "t", "draw") == rows(smoothing.draw_regimes(df.repartition(2), "k", "t", "v", p, means, 0.8, draws=120, seed=2), "t", "draw")
