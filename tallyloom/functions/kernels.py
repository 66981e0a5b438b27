"""Sequential kernels of single series, spread over groups."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.numerics import simulate_ar1
from tallyloom.plans.session import send_package


@dataclass(frozen=True)
class StateSpace:
    """x' = A x + R e, y = Z x + u, with variances Q of e and H of u."""

    a: np.ndarray
    r: np.ndarray
    q: np.ndarray
    z: np.ndarray
    h: np.ndarray

    def stationary_variance(self) -> np.ndarray:
        n = len(self.a)
        shock = self.r @ self.q @ self.r.T
        return np.linalg.solve(np.eye(n * n) - np.kron(self.a, self.a), shock.ravel()).reshape(n, n)

    def simulate(self, shocks: np.ndarray, noise: np.ndarray, start: np.ndarray) -> np.ndarray:
        x, out = np.asarray(start, dtype=float), []
        e, u = np.linalg.cholesky(self.q), np.linalg.cholesky(self.h)
        for s, n in zip(shocks, noise, strict=True):
            x = self.a @ x + self.r @ e @ s
            out.append(self.z @ x + u @ n)
        return np.array(out)

    def filtered(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Filtered states, their variances, and the log likelihood; missing observations are passed over."""
        x, p = np.zeros(len(self.a)), self.stationary_variance()
        states, variances, likelihood = [], [], 0.0
        shock = self.r @ self.q @ self.r.T
        for row in np.atleast_2d(y):
            x, p = self.a @ x, self.a @ p @ self.a.T + shock
            seen = np.isfinite(row)
            if seen.any():
                z = self.z[seen]
                f = z @ p @ z.T + self.h[np.ix_(seen, seen)]
                error = row[seen] - z @ x
                gain = np.linalg.solve(f, z @ p).T
                likelihood -= 0.5 * (seen.sum() * math.log(2 * math.pi) + np.linalg.slogdet(f)[1] + error @ np.linalg.solve(f, error))
                x, p = x + gain @ error, p - gain @ z @ p
            states.append(x)
            variances.append(p)
        return np.array(states), np.array(variances), likelihood

    def smoothed(self, y: np.ndarray) -> np.ndarray:
        """States given all observations."""
        states, variances, _ = self.filtered(y)
        out, shock = states.copy(), self.r @ self.q @ self.r.T
        for t in range(len(out) - 2, -1, -1):
            ahead = self.a @ variances[t] @ self.a.T + shock
            out[t] = states[t] + variances[t] @ self.a.T @ np.linalg.pinv(ahead) @ (out[t + 1] - self.a @ states[t])
        return out


def kalman_filter(df: DataFrame, key: str, order: str, value: str, model: StateSpace) -> DataFrame:
    """(key, order, state, smooth) of each group's series; a series is one task's, as each step needs the last."""
    send_package(df.sparkSession)
    kinds = dict(df.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        y = group[[value]].to_numpy(dtype=float)
        return pd.DataFrame({key: group[key], order: group[order], "state": model.filtered(y)[0][:, 0], "smooth": model.smoothed(y)[:, 0]})

    return df.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, state double, smooth double")


def hidden_markov(transition: np.ndarray, log_density: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Filtered and smoothed state probabilities (times by states), and the log likelihood."""
    n, k = log_density.shape
    ahead = np.full(k, 1 / k)
    for _ in range(10_000):
        moved = ahead @ transition
        if np.abs(moved - ahead).max() < 1e-14:
            break
        ahead = moved
    forward, predicted, likelihood = np.zeros((n, k)), np.zeros((n, k)), 0.0
    for t in range(n):
        predicted[t] = ahead
        top = log_density[t].max()
        joint = ahead * np.exp(log_density[t] - top)
        likelihood += math.log(joint.sum()) + top
        forward[t] = joint / joint.sum()
        ahead = forward[t] @ transition
    smooth = forward.copy()
    for t in range(n - 2, -1, -1):
        smooth[t] = forward[t] * (transition @ (smooth[t + 1] / np.maximum(predicted[t + 1], 1e-300)))
    return forward, smooth, likelihood


def regimes(df: DataFrame, key: str, order: str, value: str, transition: np.ndarray, means: Sequence[float], sd: float) -> DataFrame:
    """(key, order, state, probability): the likelier regime of each time by the smoothed probabilities."""
    send_package(df.sparkSession)
    kinds = dict(df.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        y = group[value].to_numpy(dtype=float)
        density = -0.5 * ((y[:, None] - np.asarray(means)[None, :]) / sd) ** 2 - math.log(sd * math.sqrt(2 * math.pi))
        smooth = hidden_markov(np.asarray(transition), np.where(np.isfinite(density), density, 0.0))[1]
        return pd.DataFrame({key: group[key], order: group[order], "state": smooth.argmax(axis=1), "probability": smooth.max(axis=1)})

    return df.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, state long, probability double")


def bootstrap_ar1(spark: SparkSession, rho: float, residuals: np.ndarray, n: int, draws: int = 1000, seed: int = 0, start: float | None = None) -> DataFrame:
    """(draw, rho) refitted to series simulated with n resampled residuals; draws are spread over tasks and
    each has a seed of its own, so a lost task makes the same ones again. start: the first value, less
    the mean, which the simulated ones follow."""

    send_package(spark)
    def run(frames):
        for frame in frames:
            out = []
            for d in frame["id"]:
                random = np.random.default_rng([seed, int(d)])
                x = simulate_ar1(rho, 1.0, 0.0, random.choice(residuals, n), 0.0 if start is None else start)
                x = x if start is None else np.append(start, x)
                a, b = x[:-1] - x[:-1].mean(), x[1:] - x[1:].mean()
                out.append(float(a @ b / (a @ a)))
            yield pd.DataFrame({"draw": frame["id"], "rho": out})

    return spark.range(draws).mapInPandas(run, "draw long, rho double")


def ar1_bias(spark: SparkSession, x: np.ndarray, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(draw, rho, rho_ols, rho_one_step, rho_iterated): the draws of bootstrap_ar1 at a series' own
    least-squares rho, from its own residuals, length and first value, and rho without its bias.

    One step takes the draws' mean bias off rho_ols; iterated is the rho whose draws (of the same
    residuals) have the mean rho_ols, by the secant method, null if that does not converge. A series
    of fewer than three values, or without variation, gives no rows.
    """
    x = np.asarray(x, dtype=float)
    before, after = x[:-1] - x[:-1].mean() if len(x) > 2 else np.zeros(1), x[1:] - x[1:].mean() if len(x) > 2 else np.zeros(1)
    schema = "draw long, rho double, rho_ols double, rho_one_step double, rho_iterated double"
    if not before @ before > 0:
        return spark.createDataFrame([], schema)
    ols = float(before @ after / (before @ before))
    level = x[1:].mean() - ols * x[:-1].mean()
    residuals, start = after - ols * before, float(x[0] - level / (1 - ols))

    def drawn(rho: float) -> list[tuple[int, float]]:
        made = bootstrap_ar1(spark, rho, residuals, len(residuals), draws, seed, start)
        return sorted((r["draw"], r["rho"]) for r in made.collect())

    def gap(rows: list[tuple[int, float]]) -> float:
        return ols - float(np.mean([r for _, r in rows]))

    rows = drawn(ols)
    a, gap_a = ols, gap(rows)
    b = one_step = ols + gap_a
    iterated = ols if gap_a == 0 else None
    for _ in range(30 if iterated is None else 0):
        gap_b = gap(drawn(b))
        if not np.isfinite(gap_b):
            break
        if abs(gap_b) < 1e-10:
            iterated = float(b)
            break
        if gap_a == gap_b:
            break
        a, b, gap_a = b, b - gap_b * (b - a) / (gap_b - gap_a), gap_b
    return spark.createDataFrame([(d, r, ols, one_step, iterated) for d, r in rows], schema)


def importance_sample(spark: SparkSession, log_target, draws: int, scale: float = 1.0, seed: int = 0) -> DataFrame:
    """(draw, x, log_weight) of a target density from normal draws."""

    send_package(spark)
    def run(frames):
        for frame in frames:
            x = np.array([np.random.default_rng([seed, int(d)]).normal(0, scale) for d in frame["id"]])
            log_weight = np.array([log_target(v) for v in x]) + 0.5 * (x / scale) ** 2 + math.log(scale * math.sqrt(2 * math.pi))
            yield pd.DataFrame({"draw": frame["id"], "x": x, "log_weight": log_weight})

    return spark.range(draws).mapInPandas(run, "draw long, x double, log_weight double")


def metropolis(spark: SparkSession, log_target, chains: int, steps: int, scale: float = 1.0, burn: int = 0, seed: int = 0) -> DataFrame:
    """(chain, step, x) of random-walk Metropolis chains, one task a chain."""

    send_package(spark)
    def run(frames):
        for frame in frames:
            for c in frame["id"]:
                random = np.random.default_rng([seed, int(c)])
                x, value, out = 0.0, log_target(0.0), []
                for _ in range(steps):
                    new = x + scale * random.normal()
                    there = log_target(new)
                    if math.log(random.uniform()) < there - value:
                        x, value = new, there
                    out.append(x)
                yield pd.DataFrame({"chain": c, "step": range(burn, steps), "x": out[burn:]})

    return spark.range(chains).repartition(chains).mapInPandas(run, "chain long, step long, x double")


def disaggregate(y: np.ndarray, indicator: np.ndarray, per: int, rho: float = 0.9) -> np.ndarray:
    """A high-frequency series from low-frequency means and an indicator: generalised least squares with
    first-order autoregressive errors, whose means are y."""
    n = len(y)
    means = np.kron(np.eye(n), np.full((1, per), 1 / per))
    v = rho ** np.abs(np.subtract.outer(np.arange(n * per), np.arange(n * per))) / (1 - rho * rho)
    x = np.column_stack([np.ones(n * per), indicator])
    inner = np.linalg.inv(means @ v @ means.T)
    low = means @ x
    beta = np.linalg.solve(low.T @ inner @ low, low.T @ inner @ y)
    return x @ beta + v @ means.T @ inner @ (y - low @ beta)


def random_forest(df: DataFrame, label: str, features: Sequence[str], categories: Sequence[str] = (), trees: int = 20, seed: int = 1):
    """A fitted pipeline of one-hot categories and a random forest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    steps, inputs = [], list(features)
    for c in categories:
        steps += [StringIndexer(inputCol=c, outputCol=f"_{c}_i", handleInvalid="keep"), OneHotEncoder(inputCol=f"_{c}_i", outputCol=f"_{c}_v", dropLast=False)]
        inputs.append(f"_{c}_v")
    steps += [VectorAssembler(inputCols=inputs, outputCol="_features"), RandomForestClassifier(labelCol=label, featuresCol="_features", numTrees=trees, seed=seed)]
    return Pipeline(stages=steps).fit(df)


def error_rates(df: DataFrame, label: str) -> DataFrame:
    """(error, false_positive, false_negative) of a column prediction."""
    wrong = (F.col("prediction") != F.col(label)).cast("double")
    return df.agg(
        F.avg(wrong).alias("error"),
        F.avg(F.when(F.col(label) == 0, wrong)).alias("false_positive"),
        F.avg(F.when(F.col(label) == 1, wrong)).alias("false_negative"),
    )
