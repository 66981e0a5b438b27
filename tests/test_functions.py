import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.functions import kernels, numerics, text
from tallyloom.operators import reshape


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_text(spark):
    assert one(spark, "<p> a <b>b</b> </p>\n<p>c</p>", text.strip_tags) == "abc"
    assert one(spark, "a % gone\nb \\% stays", text.remove_comments) == "a b \\% stays"
    assert one(spark, "some_snake_name", text.to_camel_case) == "someSnakeName"
    assert one(spark, "someCamelName", text.to_snake_case) == "some_camel_name"
    assert text.bracket_content("f(a(b)c) d") == ("f", "a(b)c", " d")
    assert text.bracket_content("f(a(b)c)", 2) == ("f(a", "b", "c)")
    assert text.bracket_content("f(a") is None
    assert text.remove_brackets("a{b{c}}d{") == "abcd{"


def test_numerics(spark):
    nodes = numerics.chebyshev_nodes(5)
    df = spark.createDataFrame([(float(x),) for x in nodes], "x double")
    got = np.array(rows(df.select(*numerics.chebyshev_terms(F.col("x"), 5)), "_c1") if False else [tuple(r) for r in df.select(*numerics.chebyshev_terms(F.col("x"), 5)).collect()])
    assert np.allclose(got, np.polynomial.chebyshev.chebvander(nodes, 4))
    x, w = numerics.gauss_hermite(6, 1.0, 2.0)
    assert w @ x == pytest.approx(1) and w @ (x - 1) ** 2 == pytest.approx(4)
    grid, p = numerics.rouwenhorst(0.8, 1.0, 5)
    pi = numerics.stationary(p)
    assert np.allclose(pi @ p, pi) and pi @ grid**2 == pytest.approx(1 / (1 - 0.64))
    assert numerics.newton_root(lambda v: np.array([v[0] ** 2 - 2]), np.array([1.0]))[0] == pytest.approx(2**0.5)
    data = np.random.default_rng(0).normal(3, 1, (20, 1))
    assert numerics.gmm(lambda t, d: d - t, np.array([0.0]), data)[0] == pytest.approx(data.mean())
    assert numerics.normal_z(0.95) == pytest.approx(1.959964, abs=1e-5)


def test_alias_sampler_shares():
    s = numerics.AliasSampler([1, 2, 5])
    n = len(s.share)
    mass = np.zeros(n)
    for i in range(n):
        mass[i] += s.share[i] / n
        mass[s.other[i]] += (1 - s.share[i]) / n
    assert np.allclose(mass, [1 / 8, 2 / 8, 5 / 8])


def test_kalman_passes_over_missing_values_and_equals_the_joint_normal():
    one = np.eye(1)
    m = kernels.StateSpace(0.8 * one, one, 0.5 * one, one, 0.3 * one)
    y = np.array([[0.4], [np.nan], [1.0], [-0.2]])
    states, _, likelihood = m.filtered(y)
    seen = [0, 2, 3]
    v0 = 0.5 / (1 - 0.64)
    cov = np.array([[v0 * 0.8 ** abs(i - j) for j in range(4)] for i in range(4)])
    obs = cov[np.ix_(seen, seen)] + 0.3 * np.eye(3)
    assert states[-1, 0] == pytest.approx(cov[3, seen] @ np.linalg.solve(obs, y[seen, 0]))
    want = -0.5 * (3 * np.log(2 * np.pi) + np.linalg.slogdet(obs)[1] + y[seen, 0] @ np.linalg.solve(obs, y[seen, 0]))
    assert likelihood == pytest.approx(want)
    assert np.allclose(m.smoothed(y)[:, 0], cov[:, seen] @ np.linalg.solve(obs, y[seen, 0]))


def test_hidden_markov_sums_over_all_paths():
    p = np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.3, 0.3, 0.4]])
    y = np.array([-0.3, 1.4, 0.2, 1.8])
    density = -0.5 * (y[:, None] - np.array([0.0, 1.0, 2.0])) ** 2
    forward, smooth, likelihood = kernels.hidden_markov(p, density)
    pi, total, last = numerics.stationary(p), 0.0, np.zeros(3)
    for path in np.ndindex(3, 3, 3, 3):
        w = pi[path[0]] * np.prod([p[a, b] for a, b in zip(path, path[1:])]) * np.exp(sum(density[t, s] for t, s in enumerate(path)))
        total += w
        last[path[3]] += w
    assert np.allclose(forward.sum(1), 1) and np.allclose(smooth[-1], last / total) and likelihood == pytest.approx(np.log(total))


def test_disaggregation_keeps_means():
    y = np.array([1.0, 2.0, 4.0])
    got = kernels.disaggregate(y, np.arange(12.0), 4)
    assert np.allclose(got.reshape(3, 4).mean(axis=1), y)


def test_reshape(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "k int, a double, b double")
    long = reshape.to_long(df, ["k"], ["a", "b"])
    assert rows(long) == [(1, "a", 2.0)]
    assert rows(reshape.to_wide(long, ["k"], "series", "value", ["a", "b"])) == [(1, 2.0, None)]
    assert rows(reshape.one_hot(spark.createDataFrame([("x",), (None,)], "v string"), "v", ["x", "y"]), "v") == [(None, 0, 0), ("x", 1, 0)]
    both = reshape.union_schemas([df, spark.createDataFrame([("z",)], "c string")])
    assert both.columns == ["k", "a", "b", "c"] and both.count() == 2


def test_chains_multiply(spark):
    a = spark.createDataFrame([(0, 0, 0.6), (0, 1, 0.4), (1, 1, 1.0)], "i int, j int, p double")
    sums = reshape.combine_markov_chains(a, a).groupBy("i", "k").agg(F.sum("p").alias("s"))
    assert all(s == pytest.approx(1) for *_, s in rows(sums))
