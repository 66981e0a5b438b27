"""Simulated paths, many at once as a DataFrame, and kernels of finite Markov chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.session import send_package


def uniforms(path: Column, n: int, seed: int) -> Column:
    """n numbers in (0, 1) that depend on the path, their place and the seed alone, so a lost task draws the same again."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.pmod(F.xxhash64(path, i, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52))


def normals(path: Column, n: int, seed: int) -> Column:
    """n standard normal numbers a path, by the Box-Muller transform."""
    pairs = F.arrays_zip(uniforms(path, n, 2 * seed).alias("u"), uniforms(path, n, 2 * seed + 1).alias("v"))
    return F.transform(pairs, lambda x: F.sqrt(-2 * F.ln(x["u"])) * F.cos(2 * np.pi * x["v"]))


def lognormal(normal: Column, mean: float, sd: float) -> Column:
    """Lognormal numbers from standard normal ones."""
    return F.exp(mean + sd * normal)


def along(shocks: DataFrame, start: float, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(path, t, x), t from 1: states that follow from start by step(states, shocks), for many paths at once.

    shocks: path and e, an array with a shock a period. A batch of paths is walked period by period, so the
    work grows with periods times paths and no path is copied as it grows.
    """
    send_package(shocks.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            e = np.stack(f["e"].to_numpy()) if len(f) else np.zeros((0, 0))
            x, out = np.full(len(f), float(start)), np.empty_like(e, dtype=float)
            for t in range(e.shape[1]):
                x = step(x, e[:, t])
                out[:, t] = x
            yield pd.DataFrame({"path": np.repeat(f["path"].to_numpy(), e.shape[1]), "t": np.tile(np.arange(1, e.shape[1] + 1, dtype=np.int32), len(f)), "x": out.ravel()})

    return shocks.mapInPandas(run, "path long, t int, x double")


def ar1_paths(spark: SparkSession, rho: float, sd: float, periods: int, paths: int, mean: float = 0.0, start: float | None = None, seed: int = 0) -> DataFrame:
    """(path, t, x): autoregressions of order one."""
    shocks = spark.range(paths).select(F.col("id").alias("path"), normals(F.col("id"), periods, seed).alias("e"))
    return along(shocks, mean if start is None else start, lambda x, e: mean + rho * (x - mean) + sd * e)


def cir_paths(spark: SparkSession, rho: float, sd: float, periods: int, paths: int, mean: float = 0.0, start: float | None = None, bound: bool = False, seed: int = 0) -> DataFrame:
    """(path, t, x): autoregressions whose shocks grow with the square root of the state's size; with bound, a
    state that falls below zero comes back with its sign turned, the first one too."""

    def step(x: np.ndarray, e: np.ndarray) -> np.ndarray:
        y = mean + rho * (x - mean) + sd * np.sqrt(np.abs(x)) * e
        return np.abs(y) if bound else y

    first = mean if start is None else float(start)
    shocks = spark.range(paths).select(F.col("id").alias("path"), normals(F.col("id"), periods, seed).alias("e"))
    return along(shocks, abs(first) if bound else first, step)


def choice(shares: Column, u: Column) -> Column:
    """The index from 0 of the share, in an array of shares that add up to one, on which a uniform number falls."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
    walked = F.aggregate(
        shares,
        start,
        lambda a, p: F.struct((a["sum"] + p).alias("sum"), (a["at"] + F.when(u >= a["sum"] + p, 1).otherwise(0)).alias("at")),
        lambda a: F.least(a["at"], F.size(shares) - 1),
    )
    return walked


def chain_paths(spark: SparkSession, p: np.ndarray, periods: int, paths: int, start: int | Sequence[float] = 0, seed: int = 0) -> DataFrame:
    """(path, t, state): chains with transition matrix p, from one state or drawn from shares of states."""
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in np.asarray(p)))
    path = F.col("id")
    first = F.lit(start) if isinstance(start, int) else choice(F.array(*(F.lit(float(x)) for x in start)), F.element_at(uniforms(path, 1, seed + 7919), 1))
    draws = uniforms(path, periods - 1, seed) if periods > 1 else F.array().cast("array<double>")
    along = F.aggregate(
        draws, F.array(first.cast("int")), lambda xs, u: F.concat(xs, F.array(choice(F.element_at(rows, F.element_at(xs, -1) + 1), u).cast("int")))
    )
    return spark.range(paths).select(path.alias("path"), F.posexplode(along).alias("t", "state"))


def policy_path(policy: np.ndarray | Sequence[np.ndarray], shocks: Sequence[int], start: int = 0) -> np.ndarray:
    """States that a policy (shock, state) to next state visits along shocks; a list has one policy a period."""
    out, at = [], start
    for t, z in enumerate(shocks):
        out.append(at)
        now = policy[t] if isinstance(policy, (list, tuple)) else policy
        at = int(now[z][at])
    return np.array(out)


def unit_vectors(p: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """Left eigenvectors of p for the eigenvalue one, a row each, adding up to one."""
    values, vectors = np.linalg.eig(np.asarray(p, dtype=float).T)
    found = np.real(vectors[:, np.abs(values - 1) < tolerance]).T
    return found / found.sum(axis=1, keepdims=True)


def is_stationary(shares: np.ndarray, p: np.ndarray, tolerance: float = 1e-8) -> bool:
    return bool(np.abs(shares @ p - shares).max() < tolerance)


def conditional_sd(p: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Standard deviation of the next value in each state."""
    return np.sqrt(np.maximum(0.0, p @ values**2 - (p @ values) ** 2))


def best_choices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and value of each row's largest entry, the first of equal ones."""
    at = values.argmax(axis=1)
    return at, values[np.arange(len(values)), at]
