import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.functions import collections as col
from tallyloom.functions import models


def test_priors_integrate_to_one():
    for kind, mean, sd, grid in (("normal", 1.0, 2.0, np.linspace(-15, 17, 40001)), ("gamma", 2.0, 1.0, np.linspace(1e-6, 30, 60001)), ("inverse_gamma", 2.0, 1.0, np.linspace(1e-3, 200, 400001)), ("beta", 0.4, 0.1, np.linspace(1e-6, 1 - 1e-6, 20001))):
        f = models.prior_density(kind, mean, sd)
        p = np.exp([f(x) for x in grid])
        step = grid[1] - grid[0]
        assert p.sum() * step == pytest.approx(1, abs=2e-3)
        assert (p * grid).sum() * step == pytest.approx(mean, abs=2e-2)
    with pytest.raises(ValueError):
        models.prior_density("odd", 1, 1)


def test_bayesian_var_is_least_squares_without_a_prior_and_the_prior_with_a_strong_one():
    r = np.random.default_rng(0)
    x, y = np.column_stack([np.ones(60), r.normal(size=(60, 2))]), r.normal(size=(60, 2))
    prior, precision = models.minnesota_prior([1.0, 1.0], 1)
    weak = models.bayesian_var(x.T @ x, x.T @ y, y.T @ y, 60, prior, precision * 1e-12, np.eye(2) * 1e-9, 4)
    assert np.allclose(weak.coef, np.linalg.lstsq(x, y, rcond=None)[0])
    strong = models.bayesian_var(x.T @ x, x.T @ y, y.T @ y, 60, prior, precision * 1e9, np.eye(2), 4)
    assert np.allclose(strong.coef[1:], np.eye(2), atol=1e-4)
    coef, sigma = weak.draw(r)
    assert coef.shape == (3, 2) and (np.linalg.eigvalsh(sigma) > 0).all()


def test_nonlinear_least_squares():
    t = np.linspace(0, 2, 50)
    b, se = models.nonlinear_least_squares(lambda p: np.exp(p[0] * t) + p[1] - (np.exp(0.7 * t) + 0.3), np.array([0.1, 0.0]))
    assert np.allclose(b, [0.7, 0.3]) and (se < 1e-6).all()


def test_dynamic_programmes_agree():
    r = np.random.default_rng(2)
    reward, transition = r.normal(size=(5, 3)), r.dirichlet(np.ones(5), size=(5, 3))
    value, choice = models.policy_iteration(reward, transition, 0.9)
    v = np.zeros(5)
    for _ in range(500):
        v = (reward + 0.9 * transition @ v).max(axis=1)
    assert np.allclose(value, v)
    values, choices = models.life_cycle([reward] * 400, np.zeros(5), transition, 0.9)
    assert np.allclose(values[0], v, atol=1e-8) and (choices[0] == choice).all()


def test_filters_and_disaggregation(spark):
    t = np.arange(240)
    cycle = models.full_sample_bandpass(np.sin(2 * np.pi * t / 20) + 0.01 * t, 6, 32)
    assert np.corrcoef(cycle[40:-40], np.sin(2 * np.pi * t / 20)[40:-40])[0, 1] > 0.98
    df = spark.createDataFrame([("a", int(i), float(i % 7)) for i in range(40)], "g string, t int, x double")
    assert models.series_filter(df, "g", "t", "x", 3, 12).count() == 40
    z, rho = models.chow_lin(np.array([1.0, 2.0, 2.5, 4.0]), np.arange(16.0), 4)
    assert np.allclose(z.reshape(4, 4).mean(axis=1), [1.0, 2.0, 2.5, 4.0]) and -1 < rho < 1


def test_small_solvers():
    p = models.solve_linear_expectations(np.array([[-0.3]]), np.array([[1.0]]), np.array([[-0.4]]))
    assert -0.3 + p[0, 0] - 0.4 * p[0, 0] ** 2 == pytest.approx(0)
    shock = np.random.default_rng(3).normal(size=(500, 1))
    impact = models.proxy_impact(shock @ np.array([[2.0, 1.0]]), shock[:, 0], 0)
    assert np.allclose(impact, [1.0, 0.5])
    f = models.ChebyshevApproximation(np.exp, 12, 0.0, 2.0)
    assert np.allclose(f(np.linspace(0, 2, 7)), np.exp(np.linspace(0, 2, 7)))


def test_collections(spark):
    df = spark.sql("select array(1,2,2) a, array(2,3) b, map('x1','p1','y','q') m, map('y','r') n")
    got = df.select(
        col.union(F.col("a"), F.col("b")), col.merged(F.col("m"), F.col("n")), col.merged(F.col("m"), F.col("n"), first_wins=True),
        col.renamed_keys(F.col("m"), "1", "2", True), col.split_by_lengths(F.col("a"), [1, 2]), col.has_any(F.col("a"), F.col("b")), col.has_duplicates(F.col("a")),
    ).first()
    assert list(got) == [[1, 2, 3], {"x1": "p1", "y": "r"}, {"x1": "p1", "y": "q"}, {"x2": "p2", "y": "q"}, [[1], [2, 2]], True, True]


def test_configurations():
    c = col.Configurations({"a": {"x": {"p": 1, "q": 2}, "y": 1}, "b": {"parent": "a", "x": {"q": 3}}, "c": {"parent": "c"}})
    assert c.get("b") == {"x": {"p": 1, "q": 3}, "y": 1}
    assert set(c.differences("a", "b")) == {"x"}
    with pytest.raises(ValueError):
        c.get("c")
    with pytest.raises(KeyError):
        c.get("d")
    f = col.Features({"u"}, add=("v",), remove=("u",))
    assert "v" in f and "u" not in f and f.label == "v"
    with pytest.raises(ValueError):
        col.Features(remove=("z",))


def test_ar1_bias_is_taken_off(spark):
    import numpy as np

    from tallyloom.functions import kernels

    r, x = np.random.default_rng(5), [3.0]
    for _ in range(40):
        x.append(1.0 + 0.6 * x[-1] + r.normal())
    made = kernels.ar1_bias(spark, np.array(x), draws=100, seed=1).collect()
    slope, level = np.polyfit(x[:-1], x[1:], 1)
    residuals = np.array(x[1:]) - level - slope * np.array(x[:-1])

    def mean(rho):
        start = x[0] - level / (1 - slope)
        out = []
        for d in range(100):
            path = [start]
            for e in np.random.default_rng([1, d]).choice(residuals, 40):
                path.append(rho * path[-1] + e)
            out.append(np.polyfit(path[:-1], path[1:], 1)[0])
        return np.mean(out)

    got = made[0]
    assert len(made) == 100 and abs(got.rho_ols - slope) < 1e-9
    assert abs(got.rho_one_step - (2 * slope - mean(slope))) < 1e-8 and abs(mean(got.rho_iterated) - slope) < 1e-8
    assert kernels.ar1_bias(spark, np.array([1.0, 2.0])).count() == 0 == kernels.ar1_bias(spark, np.ones(9)).count()


def test_bootstrap_query_follows_its_events(spark):
    import __spark_entry__ as entry

    one, other = ({r.rho_ols for r in entry.queries()["bootstrap_ar1"](spark, f"/root/testdata/{sf}").collect()} for sf in ("sf0.001", "sf0.01"))
    assert len(one) == len(other) == 1 and one != other
