"""Scalar mathematics as columns, and small dense kernels for the driver or a task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def logit(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.ln(x - low) - F.ln(high - x)


def logistic(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return low + (high - low) / (1 + F.exp(-x))


def log_if_positive(df: DataFrame, x: str, name: str) -> DataFrame:
    """Adds the logarithm of x, missing everywhere if one x isn't positive."""
    least = df.agg(F.min(x).alias("_least"))
    return df.join(F.broadcast(least)).withColumn(name, F.when(F.col("_least") > 0, F.ln(F.col(x)))).drop("_least")


def coupon(rate: Column, periods_a_year: int = 1, years: int = 30) -> Column:
    """Level payment a period of a loan of 1 at an annual rate."""
    r = rate / periods_a_year
    return F.when(r == 0, 1.0 / (years * periods_a_year)).otherwise(r / (1 - F.pow(1 + r, F.lit(-years * periods_a_year))))


def normal_z(p: float, two_sided: bool = True) -> float:
    return NormalDist().inv_cdf(1 - (1 - p) / 2 if two_sided else p)


def chebyshev_terms(x: Column, n: int) -> list[Column]:
    """The first n Chebyshev polynomials of x."""
    out = [F.lit(1.0), x]
    while len(out) < n:
        out.append(2 * x * out[-1] - out[-2])
    return out[:n]


def chebyshev_nodes(n: int) -> np.ndarray:
    return -np.cos((2 * np.arange(1, n + 1) - 1) * np.pi / (2 * n))


def gauss_hermite(n: int, mean: float = 0.0, sd: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of a normal distribution."""
    x, w = np.polynomial.hermite.hermgauss(n)
    return mean + sd * np.sqrt(2) * x, w / np.sqrt(np.pi)


def gradient(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, step: float = 1e-5) -> np.ndarray:
    """Central differences, one column a parameter."""
    x = np.asarray(x, dtype=float)
    columns = []
    for i in range(len(x)):
        e = np.zeros_like(x)
        e[i] = step * max(1.0, abs(x[i]))
        columns.append((np.atleast_1d(f(x + e)) - np.atleast_1d(f(x - e))) / (2 * e[i]))
    return np.array(columns).T


def newton_root(f: Callable[[np.ndarray], np.ndarray], x0: np.ndarray, tolerance: float = 1e-8, steps: int = 50) -> np.ndarray:
    """A root by Newton steps that are halved until the residual falls."""
    x = np.asarray(x0, dtype=float)
    for _ in range(steps):
        value = np.atleast_1d(f(x))
        size = np.abs(value).max()
        if size < tolerance:
            return x
        move = np.linalg.lstsq(gradient(f, x), -value, rcond=None)[0]
        scale = 1.0
        while scale > 1e-6 and not np.abs(f(x + scale * move)).max() < size:
            scale /= 2
        x = x + scale * move
    if np.abs(np.atleast_1d(f(x))).max() < tolerance:
        return x
    raise ArithmeticError("no root was reached")


def rouwenhorst(rho: float, sd: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid and transition matrix of n states that stand for an autoregression of order one."""
    p = (1 + rho) / 2
    m = np.array([[p, 1 - p], [1 - p, p]])
    for k in range(3, n + 1):
        bigger = np.zeros((k, k))
        bigger[:-1, :-1] += p * m
        bigger[:-1, 1:] += (1 - p) * m
        bigger[1:, :-1] += (1 - p) * m
        bigger[1:, 1:] += p * m
        bigger[1:-1] /= 2
        m = bigger
    width = sd / np.sqrt(1 - rho * rho) * np.sqrt(n - 1)
    return np.linspace(-width, width, n), m


def stationary(p: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """Stationary distribution by squaring the transition matrix."""
    for _ in range(200):
        q = p @ p
        q /= q.sum(axis=1, keepdims=True)
        if np.abs(q - p).max() < tolerance:
            break
        p = q
    return p.mean(axis=0)


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """(i, j, n, p): how often state j follows i in a group, and with which share."""
    follows = F.lead(state).over(Window.partitionBy(*keys).orderBy(*order))
    counts = df.select(F.col(state).alias("i"), follows.alias("j")).where("j is not null").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("i")))


class AliasSampler:
    """Draws from a discrete distribution in constant time a draw (Walker's tables)."""

    def __init__(self, weights: Sequence[float]):
        w = np.asarray(weights, dtype=float)
        if (w < 0).any() or not w.sum() > 0:
            raise ValueError("weights must be non-negative and not all zero")
        self.share = w * len(w) / w.sum()
        self.other = np.arange(len(w))
        small, large = [list(np.flatnonzero(x)) for x in (self.share < 1, self.share >= 1)]
        while small and large:
            a, b = small.pop(), large[-1]
            self.other[a] = b
            self.share[b] -= 1 - self.share[a]
            if self.share[b] < 1:
                small.append(large.pop())

    def draw(self, u: Column) -> Column:
        """Index from uniform numbers in [0, 1)."""
        n = len(self.share)
        at = F.floor(u * n).cast("int")
        keep = F.element_at(F.array(*(F.lit(float(s)) for s in self.share)), at + 1)
        other = F.element_at(F.array(*(F.lit(int(o)) for o in self.other)), at + 1)
        return F.when(u * n - at < keep, at).otherwise(other)


def simulate_ar1(rho: float, sd: float, mean: float, shocks: np.ndarray, start: float | None = None) -> np.ndarray:
    out, x = np.empty(len(shocks)), mean if start is None else start
    for i, e in enumerate(shocks):
        x = mean + rho * (x - mean) + sd * e
        out[i] = x
    return out


def gmm(moments: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, data: np.ndarray, weights: np.ndarray | None = None, steps: int = 100) -> np.ndarray:
    """Parameters that make the weighted mean moments (rows by moments) least, by Gauss-Newton steps."""
    x = np.asarray(start, dtype=float)
    mean = lambda p: np.atleast_1d(moments(p, data).mean(axis=0))
    w = np.eye(len(mean(x))) if weights is None else weights
    for _ in range(steps):
        g, d = mean(x), gradient(mean, x)
        move = -np.linalg.lstsq(d.T @ w @ d, d.T @ w @ g, rcond=None)[0]
        x = x + move
        if np.abs(move).max() < 1e-12:
            break
    return x


def stationary_by_doubling(transition: np.ndarray, start: np.ndarray | None = None, tolerance: float = 1e-12, most: int = 500) -> np.ndarray:
    """The shares that a chain settles at from start (even shares by default): each round looks twice as far
    ahead as the last, so a slow chain takes few. A chain that goes round is an error."""
    p = np.asarray(transition, dtype=float)
    shares = np.full(len(p), 1 / len(p)) if start is None else np.asarray(start, dtype=float)
    for _ in range(most):
        ahead = shares @ p
        if max(np.abs(ahead - shares).max(), np.abs(ahead @ transition - ahead).max()) < tolerance:
            return ahead / ahead.sum()
        shares, p = ahead, p @ p
    raise ArithmeticError(f"shares did not settle in {most} rounds")


def without_rare_moves(transition: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """A transition matrix without chances below least, its rows again adding up to one."""
    p = np.where(np.asarray(transition, dtype=float) < least, 0.0, transition)
    return p / p.sum(axis=1, keepdims=True)
