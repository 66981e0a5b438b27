import math

import numpy as np
import pytest

from tallyloom.functions import hierarchical as hier
from tallyloom.operators import regression as reg


def series(n=60):
    r = np.random.default_rng(1)
    y = np.zeros((n, 2))
    for t in range(1, n):
        y[t] = [0.3, 0.1] + y[t - 1] @ np.array([[0.8, 0.1], [0.0, 0.6]]) + r.normal(size=2) * [1.0, 0.5]
    return y + 2


def moments(y, lags=2):
    rows = np.column_stack([np.ones(len(y) - lags), *(y[lags - i : len(y) - i] for i in range(1, lags + 1)), y[lags:]])
    return reg.VarMoments(["a", "b"], lags, rows.T @ rows, len(rows)), rows


def test_moments_of_a_table(spark):
    y = series()
    df = spark.createDataFrame([(t, *map(float, row)) for t, row in enumerate(y)] + [(99, None, 1.0)], "t long, a double, b double")
    got, (want, _) = reg.var_moments(df, ["a", "b"], 2, ["t"]), moments(y)
    assert got.n == want.n and np.allclose(got.gram, want.gram) and np.allclose(got.means, y[2:].mean(axis=0))
    x = np.column_stack([np.ones(58), y[1:-1, 0], y[:-2, 0]])
    e = y[2:, 0] - x @ np.linalg.lstsq(x, y[2:, 0], rcond=None)[0]
    assert got.own_variances()[0] == pytest.approx(e @ e / 58)


@pytest.mark.parametrize("more", [{}, {"sums": 0.7}, {"sums": 2.0, "copersistence": 0.5}])
def test_the_marginal_likelihood_is_the_product_of_predictions(more):
    made, rows = moments(series(25))
    prior = hier.VarPrior(0.3, np.array([1.2, 0.4]), **more)
    given = prior.artificial(2, made.means)  # known before, so their own density does not count
    coef, precision = prior.regular(2)
    scale, df, total = np.diag(prior.scales), prior.df, 0.0
    for at, row in enumerate([*given, *rows]):  # each row's multivariate t density given the rows before
        x, y = row[:5], row[5:]
        spread = 1 + x @ np.linalg.solve(precision, x)
        v, e = df - 1, y - x @ coef
        wide = scale * spread / v
        total += 0 if at < len(given) else math.lgamma((v + 2) / 2) - math.lgamma(v / 2) - math.log(v * math.pi) - 0.5 * np.linalg.slogdet(wide)[1] - (v + 2) / 2 * math.log1p(e @ np.linalg.solve(wide, e) / v)
        new = precision + np.outer(x, x)
        after = np.linalg.solve(new, precision @ coef + np.outer(x, y))
        scale = scale + np.outer(y, y) + coef.T @ precision @ coef - after.T @ new @ after
        coef, precision, df = after, new, df + 1
    assert hier.log_marginal(made, prior) == pytest.approx(total)


def test_artificial_rows():
    rows = hier.VarPrior(0.3, np.array([1.2, 0.4]), sums=2.0, copersistence=4.0).artificial(2, np.array([3.0, 5.0]))
    assert rows.tolist() == [[0, 1.5, 0, 1.5, 0, 1.5, 0], [0, 0, 2.5, 0, 2.5, 0, 2.5], [0.25, 0.75, 1.25, 0.75, 1.25, 0.75, 1.25]]


def test_the_mode_is_that_of_a_grid():
    made, _ = moments(series())
    best = hier.hierarchical_var(made, copersistence=False)
    grid = np.exp(np.linspace(-4, 3, 141))
    heights = {(a, b): hier.log_marginal(made, p) + hier.log_hyperprior(p) for a in grid for b in grid for p in [hier.VarPrior(a, made.own_variances(), sums=b)]}
    top = max(heights, key=heights.get)
    assert best.log_posterior >= heights[top] - 1e-9
    assert math.log(best.prior.tightness / top[0]) == pytest.approx(0, abs=0.05) and math.log(best.prior.sums / top[1]) == pytest.approx(0, abs=0.05)
    every = hier.hierarchical_var(made)
    assert every.prior.copersistence is not None and every.posterior.coef.shape == (5, 2)
    coef, sigma = every.posterior.draw(np.random.default_rng(2))
    assert coef.shape == (5, 2) and np.linalg.eigvalsh(sigma).min() > 0


def test_gamma_by_mode():
    x = np.linspace(1e-6, 20, 400_001)
    density = np.exp([hier.log_gamma_by_mode(v, 1.0, 1.5) for v in x[::40]])
    step = x[40] - x[0]
    mean = (density * x[::40]).sum() * step
    assert density.sum() * step == pytest.approx(1, abs=1e-3) and x[::40][density.argmax()] == pytest.approx(1.0, abs=0.01)
    assert math.sqrt((density * (x[::40] - mean) ** 2).sum() * step) == pytest.approx(1.5, abs=0.01)
