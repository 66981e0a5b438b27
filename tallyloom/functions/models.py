"""Bayesian, dynamic-programming and filter kernels of small dense problems, and their fan-out."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyloom.functions.numerics import gradient
from tallyloom.plans.session import send_package


def prior_density(kind: str, mean: float, sd: float) -> Callable[[float], float]:
    """Log density of a normal, gamma, inverse gamma or beta distribution with a mean and deviation."""
    if kind == "normal":
        return lambda x: -0.5 * ((x - mean) / sd) ** 2 - math.log(sd * math.sqrt(2 * math.pi))
    if kind == "gamma":
        shape, rate = (mean / sd) ** 2, mean / sd**2
        return lambda x: shape * math.log(rate) - math.lgamma(shape) + (shape - 1) * math.log(x) - rate * x if x > 0 else -math.inf
    if kind == "inverse_gamma":
        shape = (mean / sd) ** 2 + 2
        scale = mean * (shape - 1)
        return lambda x: shape * math.log(scale) - math.lgamma(shape) - (shape + 1) * math.log(x) - scale / x if x > 0 else -math.inf
    if kind == "beta":
        total = mean * (1 - mean) / sd**2 - 1
        a, b = mean * total, (1 - mean) * total
        constant = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        return lambda x: constant + (a - 1) * math.log(x) + (b - 1) * math.log(1 - x) if 0 < x < 1 else -math.inf
    raise ValueError(f"unknown prior {kind!r}")


@dataclass(frozen=True)
class PosteriorVar:
    """Posterior of a vector autoregression under a normal-inverse-Wishart prior."""

    coef: np.ndarray
    precision: np.ndarray
    scale: np.ndarray
    df: float

    def draw(self, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """One (coefficients, error covariance)."""
        m = len(self.scale)
        root = np.linalg.cholesky(np.linalg.inv(self.scale))
        z = root @ random.normal(size=(m, int(round(self.df))))
        sigma = np.linalg.inv(z @ z.T)
        noise = np.linalg.cholesky(np.linalg.inv(self.precision)) @ random.normal(size=self.coef.shape) @ np.linalg.cholesky(sigma).T
        return self.coef + noise, sigma


def bayesian_var(xx: np.ndarray, xy: np.ndarray, yy: np.ndarray, n: float, prior_coef: np.ndarray, prior_precision: np.ndarray, prior_scale: np.ndarray, prior_df: float) -> PosteriorVar:
    """From the moments X'X, X'Y, Y'Y of n rows, so the data are read by one aggregation."""
    precision = xx + prior_precision
    coef = np.linalg.solve(precision, xy + prior_precision @ prior_coef)
    scale = prior_scale + yy + prior_coef.T @ prior_precision @ prior_coef - coef.T @ precision @ coef
    return PosteriorVar(coef, precision, (scale + scale.T) / 2, prior_df + n)


def minnesota_prior(spread: Sequence[float], lags: int, tightness: float = 0.2, decay: float = 1.0, own: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, precision) around random walks: the tighter the longer the lag; the constant is free."""
    m = len(spread)
    coef = np.zeros((1 + m * lags, m))
    coef[1 : 1 + m] = own * np.eye(m)
    sizes = [1e-8] + [(s * (lag**decay) / tightness) ** 2 for lag in range(1, lags + 1) for s in spread]
    return coef, np.diag(sizes)


def nonlinear_least_squares(residuals: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, robust errors) by damped Gauss-Newton steps."""
    b, damp = np.asarray(start, dtype=float), 1e-3
    for _ in range(steps):
        e, d = residuals(b), gradient(residuals, b)
        move = np.linalg.solve(d.T @ d + damp * np.eye(len(b)), -d.T @ e)
        if (residuals(b + move) ** 2).sum() < (e**2).sum():
            b, damp = b + move, damp / 3
        else:
            damp *= 4
        if np.abs(move).max() < 1e-12:
            break
    e, d = residuals(b), gradient(residuals, b)
    inverse = np.linalg.inv(d.T @ d)
    meat = (d * e[:, None]).T @ (d * e[:, None])
    return b, np.sqrt(np.diag(inverse @ meat @ inverse))


def policy_iteration(reward: np.ndarray, transition: np.ndarray, discount: float, steps: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(values, choices) of states by choices rewards and state by choice by state transitions."""
    choice = reward.argmax(axis=1)
    states = np.arange(len(reward))
    for _ in range(steps):
        value = np.linalg.solve(np.eye(len(reward)) - discount * transition[states, choice], reward[states, choice])
        better = (reward + discount * transition @ value).argmax(axis=1)
        gain = (reward + discount * transition @ value)[states, better] - value
        if (gain <= 1e-10).all():
            return value, choice
        choice = better
    raise ArithmeticError("policies did not settle")


def life_cycle(rewards: Sequence[np.ndarray], terminal: np.ndarray, transition: np.ndarray, discount: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Values and choices of every age, from the last one back."""
    value, values, choices = terminal, [], []
    for reward in reversed(rewards):
        total = reward + discount * transition @ value
        value = total.max(axis=1)
        values.append(value)
        choices.append(total.argmax(axis=1))
    return values[::-1], choices[::-1]


def full_sample_bandpass(x: np.ndarray, short: float, long: float) -> np.ndarray:
    """Band-pass of a whole series as a random walk's best approximation (Christiano and Fitzgerald)."""
    n = len(x)
    low, high = 2 * math.pi / long, 2 * math.pi / short
    lag = np.arange(1, n)
    b = np.r_[(high - low) / math.pi, (np.sin(high * lag) - np.sin(low * lag)) / (math.pi * lag)]
    weights = b[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    for t in range(n):
        weights[t, 0] = -(b[0] / 2 + b[1:t].sum()) if t else b[0] / 2
        weights[t, -1] = -(b[0] / 2 + b[1 : n - 1 - t].sum()) if t < n - 1 else b[0] / 2
    return weights @ x


def series_filter(df: DataFrame, key: str, order: str, value: str, short: float, long: float) -> DataFrame:
    """(key, order, cycle) of each group's series."""
    send_package(df.sparkSession)
    kinds = dict(df.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return pd.DataFrame({key: group[key], order: group[order], "cycle": full_sample_bandpass(group[value].to_numpy(float), short, long)})

    return df.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, cycle double")


def chow_lin(y: np.ndarray, indicator: np.ndarray, per: int, start: float = 0.9, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Disaggregated series and the errors' autoregression, found by repeated fits."""
    from tallyloom.functions.kernels import disaggregate

    rho = start
    for _ in range(100):
        z = disaggregate(y, indicator, per, rho)
        x = np.column_stack([np.ones(len(z)), indicator])
        e = z - x @ np.linalg.lstsq(x, z, rcond=None)[0]
        new = float(np.clip(e[:-1] @ e[1:] / max(e[:-1] @ e[:-1], 1e-300), -0.99, 0.99))
        if abs(new - rho) < tolerance:
            break
        rho = new
    return z, rho


def proxy_impact(residuals: np.ndarray, instrument: np.ndarray, policy: int) -> np.ndarray:
    """Effect of a policy shock on every residual, by an instrument, scaled to 1 on the policy variable."""
    covariance = (residuals - residuals.mean(axis=0)).T @ (instrument - instrument.mean())
    return covariance / covariance[policy]


def solve_linear_expectations(lag: np.ndarray, now: np.ndarray, lead: np.ndarray, steps: int = 2000) -> np.ndarray:
    """P of x' = P x that solves lag x + now x' + lead x'' = 0, by repeated substitution."""
    p = np.zeros_like(now)
    for _ in range(steps):
        new = -np.linalg.solve(now + lead @ p, lag)
        if np.abs(new - p).max() < 1e-13:
            return new
        p = new
    raise ArithmeticError("no stable solution was reached")


class ChebyshevApproximation:
    """A function on an interval by Chebyshev polynomials through its nodes."""

    def __init__(self, f: Callable[[np.ndarray], np.ndarray], n: int, low: float = -1.0, high: float = 1.0):
        from tallyloom.functions.numerics import chebyshev_nodes

        nodes = chebyshev_nodes(n)
        self.low, self.high = low, high
        self.coef = np.linalg.solve(np.polynomial.chebyshev.chebvander(nodes, n - 1), f((nodes + 1) * (high - low) / 2 + low))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.polynomial.chebyshev.chebval(2 * (x - self.low) / (self.high - self.low) - 1, self.coef)
