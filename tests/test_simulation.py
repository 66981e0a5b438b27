import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import dense, simulation
from tallyloom.operators import panel, quantiles, regression, reshape


def test_linear_algebra():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(4, 4)), r.normal(size=(3, 4))
    spd = a @ a.T + np.eye(4)
    assert np.allclose(dense.clipped_factor(spd) @ dense.clipped_factor(spd).T, spd)
    assert np.allclose(dense.column_factor(spd), np.linalg.cholesky(spd))
    assert np.allclose(dense.solve_right(b, a) @ a, b)
    flat = np.outer([1.0, 2.0], [3.0, 1.0])
    assert np.allclose(dense.pseudo_inverse(flat), np.linalg.pinv(flat))
    assert np.allclose(dense.quadratic_form(a, spd), a.T @ spd @ a)
    assert np.allclose(np.cov(dense.normal_draws(spd, 200_000, 3).T), spd, rtol=0.05, atol=0.1)
    assert dense.normal_band(0.95) == pytest.approx((-1.959964, 1.959964), abs=1e-6)


def test_derivatives_quadrature_and_roots():
    f = lambda x: float(np.sin(x[0]) * x[1] ** 2 + x[0])
    assert np.allclose(dense.hessian(f, np.array([0.5, 2.0])), [[-np.sin(0.5) * 4, np.cos(0.5) * 4], [np.cos(0.5) * 4, 2 * np.sin(0.5)]], atol=1e-5)
    x, w = dense.gauss_legendre(6, 0.0, 2.0)
    assert (w * x**5).sum() == pytest.approx(64 / 6)
    assert dense.secant_root(lambda x: x**3 - 2, 1.0, 2.0, 1e-12) == pytest.approx(2 ** (1 / 3))
    with pytest.raises(ArithmeticError):
        dense.secant_root(lambda x: 1.0, 0.0, 1.0)


def test_tensors():
    basis, slopes = dense.chebyshev_basis(np.array([0.3, -0.7]), 5)
    assert np.allclose(basis, np.cos(np.outer(np.arccos([0.3, -0.7]), range(5))))
    up, down = (dense.chebyshev_basis(np.array([0.3, -0.7]) + h, 5)[0] for h in (1e-6, -1e-6))
    assert np.allclose(slopes, (up - down) / 2e-6, atol=1e-6)
    fit = dense.TensorFit((6, 5), [0.0, -1.0], [2.0, 3.0])
    f = lambda p: p[:, 0] ** 3 * p[:, 1] ** 2 + p[:, 1]
    fit.fit(f(fit.nodes()))
    points = np.random.default_rng(2).uniform([0, -1], [2, 3], (50, 2))
    assert np.allclose(fit(points, rows=7), f(points))


def test_paths(spark):
    x = simulation.ar1_paths(spark, 0.5, 1.0, 20, 3000, mean=2.0, seed=4)
    end = x.where("t = 20").agg(F.avg("x"), F.var_samp("x"), F.count(F.lit(1))).first()
    assert end[0] == pytest.approx(2, abs=0.1) and end[1] == pytest.approx(1 / 0.75, rel=0.15) and end[2] == 3000
    assert x.orderBy("path", "t").head(5) == simulation.ar1_paths(spark, 0.5, 1.0, 20, 3000, mean=2.0, seed=4).repartition(3).orderBy("path", "t").head(5)
    assert simulation.cir_paths(spark, 0.9, 0.5, 30, 50, mean=0.1, bound=True).agg(F.min("x")).first()[0] >= 0
    free = simulation.cir_paths(spark, 0.9, 0.5, 30, 50, mean=0.1, start=-0.2)
    below = free.where("x < 0").count()
    turned = simulation.cir_paths(spark, 0.9, 0.5, 30, 50, mean=0.1, start=-0.2, bound=True)
    assert below > 0 and turned.where("t = 1 and x < 0").isEmpty() and turned.agg(F.min("x")).first()[0] >= 0
    ids = [r["path"] for r in free.where("t = 1").select("path").collect()]
    shocks = dict(spark.range(50).select("id", simulation.normals(F.col("id"), 30, 0).alias("e")).collect())
    got = {(r["path"], r["t"]): r["x"] for r in free.collect()}
    for i in ids[:3]:
        x = -0.2
        for t in range(1, 31):
            x = 0.1 + 0.9 * (x - 0.1) + 0.5 * abs(x) ** 0.5 * shocks[i][t - 1]
            assert abs(got[i, t] - x) < 1e-9
    p = np.array([[0.9, 0.1], [0.4, 0.6]])
    chain = simulation.chain_paths(spark, p, 40, 1000, start=[0.8, 0.2], seed=1)
    assert chain.count() == 40_000 and chain.agg(F.avg("state")).first()[0] == pytest.approx(0.2, abs=0.03)
    assert simulation.chain_paths(spark, np.eye(2), 3, 2, start=1).agg(F.min("state")).first()[0] == 1


def test_chains():
    p = np.array([[0.9, 0.1, 0.0], [0.4, 0.6, 0.0], [0.0, 0.0, 1.0]])
    found = simulation.unit_vectors(p)
    assert len(found) == 2 and all(simulation.is_stationary(v, p) for v in found) and not simulation.is_stationary(np.array([1.0, 0, 0]), p)
    assert np.allclose(simulation.conditional_sd(p, np.array([0.0, 1.0, 5.0])), [0.3, np.sqrt(0.24), 0])
    at, best = simulation.best_choices(np.array([[1, 3, 3], [2, 0, 1]]))
    assert at.tolist() == [1, 0] and best.tolist() == [3, 2]
    policy = np.array([[1, 2, 0], [0, 0, 0]])
    assert simulation.policy_path(policy, [0, 0, 1, 0]).tolist() == [0, 1, 2, 0]
    assert simulation.policy_path([policy, policy[::-1]], [0, 0]).tolist() == [0, 1]


def test_grids_dates_and_errors(spark):
    grid = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, x double")
    other = spark.createDataFrame([(1, 5.0), (2, 7.0)], "k int, y double")
    assert sorted(tuple(r) for r in reshape.combine_rows(grid, other, ["k"]).collect()) == [(1, 10.0), (1, 15.0)]
    with pytest.raises(ValueError):
        reshape.bounded(grid, 1)
    chain = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5 - 1e-9), (0, 2, 1e-9)], "i int, j int, p double")
    kept = reshape.drop_low_probabilities(chain).collect()
    assert len(kept) == 2 and sum(r.p for r in kept) == pytest.approx(1)
    days = [str(r.date) for r in panel.period_starts(spark, "2020-02-10", 3, "quarter").orderBy("date").collect()]
    assert days == ["2020-04-01", "2020-07-01", "2020-10-01"]
    got = spark.createDataFrame([(2020, 2), (2020, 13)], "y int, m int").select(panel.month_start(F.col("y"), F.col("m")), panel.year_start(F.col("y"))).collect()
    assert [[str(x) for x in r] for r in got] == [["2020-02-01", "2020-01-01"], ["None", "2020-01-01"]]
    rows = spark.createDataFrame([(float(i * i % 17), f"a{i % 4}", f"b{min(i % 4, i % 7)}") for i in range(60)], "x double, g string, h string")
    with pytest.raises(ArithmeticError):
        regression.absorb_effects(rows, ["x"], ["g", "h"], sweeps=1)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 9, 10])
def test_simpson_of_odd_and_even_curves(spark, n):
    """Each three points are integrated by their parabola; the last interval of an even number by the last three's."""
    v = np.cumsum(np.arange(1, n + 1) % 4 + 1.0)
    pop, value = np.arange(1, n + 1) / n, np.cumsum(v) / v.sum()
    area = (value[0] + value[1]) / 2 * (pop[1] - pop[0]) if n == 2 else 0.0
    for k in range(2, n, 2):
        c = np.polyint(np.polyfit(pop[k - 2 : k + 1], value[k - 2 : k + 1], 2))
        area += np.polyval(c, pop[k]) - np.polyval(c, pop[k - 2])
    if n > 2 and n % 2 == 0:
        c = np.polyint(np.polyfit(pop[-3:], value[-3:], 2))
        area += np.polyval(c, pop[-1]) - np.polyval(c, pop[-2])
    got = quantiles.gini_simpson(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").first()[0]
    assert got == pytest.approx(1 - 2 * area)
