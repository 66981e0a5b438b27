"""Vector autoregressions whose prior's own parameters are chosen by the data, from moments alone."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np

from tallyloom.functions.models import PosteriorVar, bayesian_var
from tallyloom.operators.regression import VarMoments

#: Modes and deviations of the gamma distributions of tightness, sums of coefficients and co-persistence.
MODES, DEVIATIONS = (0.2, 1.0, 1.0), (0.4, 1.0, 1.0)
#: Precision of the constant.
FREE = 1e-6


@dataclass(frozen=True)
class VarPrior:
    """A prior around random walks.

    tightness: deviation of first own lags at equal scales; lags further back are tighter by their
    square. scales: of the error variances, one a variable. sums and copersistence: how loosely the
    variables' lags add up to one alone, and together with the constant (None: not at all).
    """

    tightness: float
    scales: np.ndarray
    sums: float | None = None
    copersistence: float | None = None

    @property
    def df(self) -> float:
        return len(self.scales) + 2.0

    def regular(self, lags: int) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients, precision): terms are the constant and then all variables lag by lag."""
        m = len(self.scales)
        coef = np.vstack([np.zeros(m), np.eye(m), np.zeros((m * (lags - 1), m))])
        spread = self.scales / ((self.df - m - 1) * self.tightness**2)
        return coef, np.diag(np.r_[FREE, *(spread * lag**2 for lag in range(1, lags + 1))])

    def artificial(self, lags: int, means: np.ndarray) -> np.ndarray:
        """Rows (terms, variables) that say how lags add up, at the variables' means."""
        m = len(self.scales)
        rows = []
        if self.sums is not None:
            rows += [np.r_[0.0, np.tile(means * (np.arange(m) == i), lags + 1)] / self.sums for i in range(m)]
        if self.copersistence is not None:
            rows.append(np.r_[1.0, np.tile(means, lags + 1)] / self.copersistence)
        return np.array(rows).reshape(-1, 1 + m * (lags + 1))


def log_multigamma(x: float, m: int) -> float:
    return m * (m - 1) / 4 * math.log(math.pi) + sum(math.lgamma(x - j / 2) for j in range(m))


def posterior_of(gram: np.ndarray, n: float, lags: int, prior: VarPrior) -> PosteriorVar:
    k = 1 + len(prior.scales) * lags
    coef, precision = prior.regular(lags)
    return bayesian_var(gram[:k, :k], gram[:k, k:], gram[k:, k:], n, coef, precision, np.diag(prior.scales), prior.df)


def log_evidence(gram: np.ndarray, n: float, lags: int, prior: VarPrior) -> float:
    """Log density of rows with these second moments, the coefficients and variances integrated out."""
    m = len(prior.scales)
    made, (_, precision) = posterior_of(gram, n, lags, prior), prior.regular(lags)
    return (
        -n * m / 2 * math.log(math.pi)
        + log_multigamma((prior.df + n) / 2, m)
        - log_multigamma(prior.df / 2, m)
        + m / 2 * (np.linalg.slogdet(precision)[1] - np.linalg.slogdet(made.precision)[1])
        + prior.df / 2 * np.log(prior.scales).sum()
        - (prior.df + n) / 2 * np.linalg.slogdet(made.scale)[1]
    )


def log_marginal(moments: VarMoments, prior: VarPrior) -> float:
    """Log marginal likelihood of the series; artificial rows belong to the prior, so theirs is taken off."""
    rows = prior.artificial(moments.lags, moments.means)
    extra = rows.T @ rows
    whole = log_evidence(moments.gram + extra, moments.n + len(rows), moments.lags, prior)
    return whole - (log_evidence(extra, len(rows), moments.lags, prior) if len(rows) else 0.0)


def log_gamma_by_mode(x: float, mode: float, sd: float) -> float:
    """Log density of the gamma distribution with this mode and deviation."""
    ratio = 2 + (mode / sd) ** 2
    shape = (ratio + math.sqrt(ratio * ratio - 4)) / 2
    scale = mode / (shape - 1)
    return (shape - 1) * math.log(x) - x / scale - math.lgamma(shape) - shape * math.log(scale)


def log_hyperprior(prior: VarPrior, modes: Sequence[float] = MODES, deviations: Sequence[float] = DEVIATIONS) -> float:
    values = (prior.tightness, prior.sums, prior.copersistence)
    return sum(log_gamma_by_mode(v, a, s) for v, a, s in zip(values, modes, deviations, strict=True) if v is not None)


def lowest(f: Callable[[np.ndarray], float], start: np.ndarray, width: float = 0.5, tolerance: float = 1e-9, most: int = 5000) -> np.ndarray:
    """Where f is least near start, by a simplex that turns over, stretches and shrinks."""
    n = len(start)
    points = [np.asarray(start, dtype=float)] + [start + width * np.eye(n)[i] for i in range(n)]
    heights = [f(p) for p in points]
    for _ in range(most):
        order = np.argsort(heights)
        points, heights = [points[i] for i in order], [heights[i] for i in order]
        if heights[-1] - heights[0] <= tolerance and max(np.abs(p - points[0]).max() for p in points) <= math.sqrt(tolerance):
            return points[0]
        middle = np.mean(points[:-1], axis=0)
        way = middle - points[-1]
        over = middle + way
        height = f(over)
        if height < heights[0]:
            far = middle + 2 * way
            top = f(far)
            points[-1], heights[-1] = (far, top) if top < height else (over, height)
        elif height < heights[-2]:
            points[-1], heights[-1] = over, height
        else:
            near = middle + (0.5 if height < heights[-1] else -0.5) * way
            top = f(near)
            if top < min(height, heights[-1]):
                points[-1], heights[-1] = near, top
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                heights = [heights[0], *(f(p) for p in points[1:])]
    raise ArithmeticError("the search did not settle")


@dataclass(frozen=True)
class HierarchicalVar:
    """The prior at the mode of its parameters' posterior, that mode's height, and the posterior it gives."""

    prior: VarPrior
    log_posterior: float
    log_marginal: float
    posterior: PosteriorVar


def hierarchical_var(moments: VarMoments, sums: bool = True, copersistence: bool = True, scales: np.ndarray | None = None) -> HierarchicalVar:
    """A vector autoregression with the prior parameters that the data make likeliest.

    The data are read once, for the moments; the search is over up to three numbers and matrices of the
    size of the coefficients. scales: by default the residual variances of each variable on its own lags.
    """
    scales = moments.own_variances() if scales is None else np.asarray(scales, dtype=float)
    names = ["tightness", *(["sums"] if sums else []), *(["copersistence"] if copersistence else [])]
    first = replace(VarPrior(MODES[0], scales), **dict.fromkeys(names[1:], 1.0))

    def at(logs: np.ndarray) -> VarPrior:
        return replace(first, **{k: float(v) for k, v in zip(names, np.exp(np.clip(logs, -12, 12)), strict=True)})

    def height(prior: VarPrior) -> float:
        return log_marginal(moments, prior) + log_hyperprior(prior)

    best = at(lowest(lambda logs: -height(at(logs)), np.log([getattr(first, n) for n in names])))
    rows = best.artificial(moments.lags, moments.means)
    return HierarchicalVar(best, height(best), log_marginal(moments, best), posterior_of(moments.gram + rows.T @ rows, moments.n + len(rows), moments.lags, best))
