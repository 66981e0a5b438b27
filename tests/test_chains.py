import math

import numpy as np
import pytest
from conftest import rows

from tallyloom.functions import chains


def normal(mean, sd):
    mean, sd = np.asarray(mean, dtype=float), np.asarray(sd, dtype=float)
    return lambda x: float(-0.5 * (((x - mean) / sd) ** 2).sum() - np.log(sd * math.sqrt(2 * math.pi)).sum())


def walk(**more):
    return chains.Walk(normal([1.0, -2.0, 0.5], [1.0, 2.0, 0.5]), np.diag([1.0, 4.0, 0.25]), scale=1.2, **more)


STARTS = np.array([[0.0, 0, 0], [1, 1, 1], [-1, 0, 2]])


def told(df):
    return [(c, s, tuple(x), v, k, a, t) for c, s, x, v, k, a, t in rows(df.select("chain", "step", "x", "log_density", "scale", "accepted", "tried"), "chain", "step")]


def test_stopped_and_resumed_chains_equal_unbroken_ones(spark, tmp_path):
    own = walk(blocks=2, adapt_every=7)
    whole = chains.ChainStore(spark, f"{tmp_path}/whole", own, seed=3)
    whole.start(STARTS)
    want = told(whole.run(60, segment=60))
    first = chains.ChainStore(spark, f"{tmp_path}/parts", own, seed=3)
    first.start(STARTS)
    first.run(25, segment=10)
    again = chains.ChainStore(spark, f"{tmp_path}/parts", own, seed=3)  # as a new session would
    again.start(np.zeros((1, 3)))  # has begun already
    assert told(again.run(60, segment=17)) == want
    assert again.segments() == [0, 1, 11, 21, 26, 43, 60]
    assert len(want) == 3 * 61 and len({k for *_, k, _, _ in want}) > 3


def test_a_segment_that_was_not_committed_is_made_again(spark, tmp_path):
    own = walk()
    store = chains.ChainStore(spark, f"{tmp_path}/c", own, seed=4)
    store.start(STARTS)
    want = told(store.run(20, segment=5))
    (tmp_path / "c/from_16/_SUCCESS").unlink()
    assert store.segments() == [0, 1, 6, 11]
    assert told(store.run(20, segment=5)) == want


def test_chains_find_moments_and_stay_inside(spark, tmp_path):
    own = chains.Walk(normal([0.0, 0.0], [1.0, 1.0]), np.eye(2), scale=1.5, low=np.array([0.0, -9.0]), high=np.array([9.0, 9.0]))
    store = chains.ChainStore(spark, f"{tmp_path}/b", own, seed=5)
    store.start(np.full((8, 2), 0.5))
    draws = store.run(1500, segment=700)
    assert draws.where("x[0] < 0").isEmpty()
    got = {r["parameter"]: r for r in chains.chain_summary(draws, burn=200).collect()}
    assert got[0]["mean"] == pytest.approx(math.sqrt(2 / math.pi), abs=0.06) and got[1]["mean"] == pytest.approx(0.0, abs=0.1)
    assert got[1]["sd"] == pytest.approx(1.0, abs=0.07) and all(r["r_hat"] < 1.05 and r["n"] == 8 * 1300 for r in got.values())


def test_a_store_without_start(spark, tmp_path):
    with pytest.raises(ValueError, match="no start"):
        chains.ChainStore(spark, f"{tmp_path}/none", walk()).run(5)


def test_jumps_and_blocks():
    assert chains.jump_factor(0.25) == 1.0
    assert 0.95 < chains.jump_factor(0.0) < 1 < chains.jump_factor(1.0) < 1.0500001
    blocks = chains.random_blocks(7, 3, np.random.default_rng(1))
    assert sorted(np.concatenate(blocks)) == list(range(7)) and sorted(map(len, blocks)) == [2, 2, 3]
    with pytest.raises(ValueError, match="blocks"):
        chains.random_blocks(2, 3, np.random.default_rng(1))


def test_resampling_keeps_shares(spark):
    weights = [0.0, 5.0, 1.0, 0.0, 2.0, 2.0, 0.0]
    made = spark.createDataFrame([(i, [float(i)], 0.0, math.log(w) if w else -math.inf) for i, w in enumerate(weights)], chains.PARTICLE).repartition(3)
    for shift in (0.001, 0.4, 0.999):
        got = rows(chains.resampled(made, shift).select("id", "x"), "id")
        assert [i for i, _ in got] == list(range(7))
        counts = [sum(x[0] == i for _, x in got) for i in range(7)]
        assert all(abs(c - 0.7 * w) < 1 for c, w in zip(counts, weights, strict=True)), counts


def test_particles_find_posterior_and_evidence(spark):
    data, sd, wide = np.random.default_rng(2).normal(1.5, 1.0, 20), 1.0, 3.0
    n = len(data)
    likelihood = lambda x: float(-0.5 * ((data - x[0]) ** 2).sum() / sd**2 - n * math.log(sd * math.sqrt(2 * math.pi)))
    made = chains.tempered_particles(spark, likelihood, lambda r: r.normal(0, wide, 1), normal([0.0], [wide]), particles=1500, seed=6)
    precision = n / sd**2 + 1 / wide**2
    mean = data.sum() / sd**2 / precision
    cov = sd**2 * np.eye(n) + wide**2
    evidence = -0.5 * (n * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + data @ np.linalg.solve(cov, data))
    x = np.array([r["x"][0] for r in made.particles.collect()])
    assert len(x) == 1500 and made.particles.select("id").distinct().count() == 1500
    assert x.mean() == pytest.approx(mean, abs=0.04) and x.std() == pytest.approx(precision**-0.5, rel=0.12)
    assert made.log_evidence == pytest.approx(evidence, abs=0.25)
    assert made.steps[-1][0] == 1.0 and all(s > 0.3 for _, s, _ in made.steps)
