"""Smoothed shocks, decompositions and joint draws of state-space and hidden-state models, series by series."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.kernels import StateSpace, hidden_markov
from tallyloom.plans.session import send_package

#: Draws that one task makes of one series.
DRAWS_A_TASK = 50


@dataclass(frozen=True)
class Disturbances:
    """What a whole series tells about each time: states, shocks into them, measurement noise (missing
    where the observation is), and the state before the first time."""

    states: np.ndarray
    shocks: np.ndarray
    noise: np.ndarray
    start: np.ndarray


def disturbances(model: StateSpace, y: np.ndarray) -> Disturbances:
    """Expectations given all observations, by one pass forward and one of the weighted errors backward.

    y: times by variables, with NaN where nothing was observed. The state before the first time has
    the stationary distribution.
    """
    y = np.atleast_2d(np.asarray(y, dtype=float))
    k = len(model.a)
    x, p0 = np.zeros(k), model.stationary_variance()
    p, into = p0, model.r @ model.q @ model.r.T
    steps = []
    for row in y:
        x, p = model.a @ x, model.a @ p @ model.a.T + into
        seen = np.isfinite(row)
        z = model.z[seen]
        weight = np.linalg.solve(z @ p @ z.T + model.h[np.ix_(seen, seen)], z)  # F^-1 Z
        error = row[seen] - z @ x
        left = np.eye(k) - p @ z.T @ weight
        steps.append((weight.T @ error, model.a @ left))
        x, p = x + p @ weight.T @ error, left @ p
    pull, pulls = np.zeros(k), np.zeros((len(y), k))
    for t in range(len(y) - 1, -1, -1):
        told, carried = steps[t]
        pull = told + carried.T @ pull
        pulls[t] = pull
    shocks = pulls @ (model.q @ model.r.T).T
    start = p0 @ model.a.T @ pulls[0] if len(y) else np.zeros(k)
    states = driven(model, shocks, start)
    return Disturbances(states, shocks, y - states @ model.z.T, start)


def driven(model: StateSpace, shocks: np.ndarray, start: np.ndarray) -> np.ndarray:
    """States that follow from a start and shocks."""
    out, x = np.zeros((len(shocks), len(model.a))), np.asarray(start, dtype=float)
    for t, e in enumerate(shocks):
        x = model.a @ x + model.r @ e
        out[t] = x
    return out


def decomposed(model: StateSpace, shocks: np.ndarray, start: np.ndarray, begin: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(shock by time by state, time by state): what each shock adds to the states from time begin on, and what the
    state at begin leaves; before begin the second has all. They add up to the states."""
    whole = driven(model, shocks, start)
    none = np.zeros(len(model.a))
    parts = np.zeros((shocks.shape[1], *whole.shape))
    base = whole.copy()
    if begin < len(shocks):
        held = whole[begin - 1] if begin else np.asarray(start, dtype=float)
        base[begin:] = driven(model, np.zeros_like(shocks[begin:]), held)
        for j in range(shocks.shape[1]):
            alone = np.zeros_like(shocks[begin:])
            alone[:, j] = shocks[begin:, j]
            parts[j, begin:] = driven(model, alone, none)
    return parts, base


def draw_disturbances(model: StateSpace, y: np.ndarray, random: np.random.Generator) -> Disturbances:
    """One joint draw of states, shocks and noise given all observations: a simulated series, and the
    expectations for what the observations differ from it (Durbin and Koopman)."""
    y = np.atleast_2d(np.asarray(y, dtype=float))

    def drawn(variance: np.ndarray, n: int) -> np.ndarray:
        values, vectors = np.linalg.eigh(variance)
        return random.normal(size=(n, len(variance))) @ (vectors * np.sqrt(np.clip(values, 0, None))).T

    start, shocks, noise = drawn(model.stationary_variance(), 1)[0], drawn(model.q, len(y)), drawn(model.h, len(y))
    states = driven(model, shocks, start)
    told = disturbances(model, y - (states @ model.z.T + noise))
    states = states + told.states
    return Disturbances(states, shocks + told.shocks, y - states @ model.z.T, start + told.start)


def by_series(df: DataFrame, key: str, order: str, values: Sequence[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """work(frame in order, its values) of each key's series; the schema begins with key and order."""
    send_package(df.sparkSession)
    kinds = dict(df.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order).reset_index(drop=True)
        return work(group, group[list(values)].to_numpy(dtype=float))

    return df.select(key, order, *values).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {schema}")


def smooth_shocks(df: DataFrame, key: str, order: str, values: Sequence[str], model: StateSpace, shocks: Sequence[str], begin: int = 0) -> DataFrame:
    """Each series taken apart into what its smoothed shocks add to each of its values.

    Returns key, order, shock_<s> for every shock, and for every value v part_<v>_<s>, base_<v> and
    noise_<v>, which add up to v. begin: the time from which shocks are told apart; what came before
    is in base. Values may be missing; a series is one task's, as each step needs the last.
    """

    def work(group: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        told = disturbances(model, y)
        parts, base = decomposed(model, told.shocks, told.start, begin)
        out = {c: group[c] for c in (key, order)} | {f"shock_{s}": told.shocks[:, j] for j, s in enumerate(shocks)}
        for i, v in enumerate(values):
            out |= {f"part_{v}_{s}": parts[j] @ model.z[i] for j, s in enumerate(shocks)}
            out |= {f"base_{v}": base @ model.z[i], f"noise_{v}": told.noise[:, i]}
        return pd.DataFrame(out)

    names = [f"shock_{s}" for s in shocks] + [n for v in values for n in (*(f"part_{v}_{s}" for s in shocks), f"base_{v}", f"noise_{v}")]
    return by_series(df, key, order, values, work, ", ".join(f"{n} double" for n in names))


def dealt_draws(df: DataFrame, key: str, draws: int) -> DataFrame:
    """A copy of each series for every block of draws, in column _block."""
    return df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(max(draws - 1, 0) // DRAWS_A_TASK))))


def draw_generator(seed: int, key: object, draw: int) -> np.random.Generator:
    """The same for a key and a draw wherever and however often they are made."""
    return np.random.default_rng([seed, zlib.crc32(str(key).encode()), draw])


def draw_states(df: DataFrame, key: str, order: str, values: Sequence[str], model: StateSpace, draws: int, seed: int = 0) -> DataFrame:
    """(key, order, draw, state_<i>, shock_<j>): joint draws of the paths given each series. Blocks of
    draws of a series are tasks of their own; a lost one makes the same draws again."""
    send_package(df.sparkSession)
    kinds, k, e = dict(df.dtypes), len(model.a), model.q.shape[0]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["_block"].iloc[0])
        group = group.sort_values(order)
        y, out = group[list(values)].to_numpy(dtype=float), []
        for d in range(block * DRAWS_A_TASK, min(draws, (block + 1) * DRAWS_A_TASK)):
            made = draw_disturbances(model, y, draw_generator(seed, group[key].iloc[0], d))
            out.append(pd.DataFrame({key: group[key], order: group[order], "draw": d} | {f"state_{i}": made.states[:, i] for i in range(k)} | {f"shock_{j}": made.shocks[:, j] for j in range(e)}))
        return pd.concat(out)

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, draw long, " + ", ".join([*(f"state_{i} double" for i in range(k)), *(f"shock_{j} double" for j in range(e))])
    return dealt_draws(df.select(key, order, *values), key, draws).groupBy(key, "_block").applyInPandas(run, schema)


def quantile_names(levels: Sequence[float]) -> list[str]:
    return [f"q{round(100 * q)}" for q in levels]


def normal_log_density(y: np.ndarray, means: Sequence[float], sd: float) -> np.ndarray:
    """Times by states; a missing value tells nothing."""
    density = -0.5 * ((y[:, None] - np.asarray(means, dtype=float)[None, :]) / sd) ** 2 - math.log(sd * math.sqrt(2 * math.pi))
    return np.where(np.isfinite(density), density, 0.0)


def regime_values(df: DataFrame, key: str, order: str, value: str, transition: np.ndarray, means: Sequence[float], sd: float, levels: Sequence[float]) -> DataFrame:
    """(key, order, filtered, smoothed, q<level>...): expectations of the hidden states' means given the
    series so far and as a whole, and quantiles of the smoothed distribution.

    Quantiles run in straight lines between the states, in their order, at the smoothed cumulative
    probabilities; below the first one they are the first state's.
    """
    grid = np.asarray(means, dtype=float)

    def work(group: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        forward, smooth, _ = hidden_markov(np.asarray(transition), normal_log_density(y[:, 0], means, sd))
        below = np.cumsum(smooth, axis=1)
        marks = {n: [np.interp(q, b, grid) for b in below] for n, q in zip(quantile_names(levels), levels, strict=True)}
        return pd.DataFrame({key: group[key], order: group[order], "filtered": forward @ grid, "smoothed": smooth @ grid} | marks)

    return by_series(df, key, order, [value], work, ", ".join(f"{n} double" for n in ("filtered", "smoothed", *quantile_names(levels))))


def sampled_regimes(transition: np.ndarray, forward: np.ndarray, random: np.random.Generator, draws: int) -> np.ndarray:
    """Times by draws: paths of hidden states given all observations, drawn from the last one back."""
    n = len(forward)
    out = np.zeros((n, draws), dtype=np.int64)
    ahead = None
    for t in range(n - 1, -1, -1):
        chance = np.broadcast_to(forward[t], (draws, forward.shape[1])) if ahead is None else forward[t] * transition[:, ahead].T
        edges = np.cumsum(chance, axis=1)
        ahead = (random.uniform(size=draws)[:, None] * edges[:, -1:] >= edges).sum(axis=1).clip(max=forward.shape[1] - 1)
        out[t] = ahead
    return out


def draw_regimes(df: DataFrame, key: str, order: str, value: str, transition: np.ndarray, means: Sequence[float], sd: float, draws: int, seed: int = 0) -> DataFrame:
    """(key, order, draw, state): joint draws of each series' hidden states, in blocks as draw_states makes them."""
    send_package(df.sparkSession)
    kinds = dict(df.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["_block"].iloc[0])
        group = group.sort_values(order)
        forward, _, _ = hidden_markov(np.asarray(transition), normal_log_density(group[value].to_numpy(dtype=float), means, sd))
        low = block * DRAWS_A_TASK
        made = sampled_regimes(np.asarray(transition), forward, draw_generator(seed, group[key].iloc[0], low), min(draws - low, DRAWS_A_TASK))
        return pd.concat([pd.DataFrame({key: group[key], order: group[order], "draw": low + d, "state": made[:, d]}) for d in range(made.shape[1])])

    return dealt_draws(df.select(key, order, value), key, draws).groupBy(key, "_block").applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, draw long, state long")
