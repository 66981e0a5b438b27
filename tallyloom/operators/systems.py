"""Systems of equations from aggregated moments: joint tests, error correction, long horizons, moment estimators."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.panel import add_lags, ordered
from tallyloom.operators.quantiles import finite
from tallyloom.operators.regression import Fit, VectorFit, regression, shifted, symmetric_sum, term_column


def upper_chi_square(x: float, df: int) -> float:
    """The probability that a chi-square variable of df degrees exceeds x: a series below the mean, a
    continued fraction above it."""
    a, half = df / 2, x / 2
    if half <= 0:
        return 1.0
    head = math.exp(a * math.log(half) - half - math.lgamma(a))
    if half < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= half / n
            total += term
        return 1 - head * total
    b = half + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return head * out


@dataclass(frozen=True)
class SystemFit:
    """Equations with the same right-hand side. cov is that of all coefficients, equation by equation."""

    left: list[str]
    terms: list[str]
    coef: np.ndarray
    sigma: np.ndarray
    cov: np.ndarray
    n: int

    def at(self, term: str, left: str) -> int:
        return self.left.index(left) * len(self.terms) + self.terms.index(term)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None)).reshape(len(self.left), -1).T

    def combination(self, weights: Mapping[tuple[str, str], float]) -> tuple[float, float]:
        """A weighted sum of coefficients (term, equation) and its standard error."""
        w = np.zeros(len(self.cov))
        for (term, left), value in weights.items():
            w[self.at(term, left)] = value
        return float(w @ self.coef.T.ravel()), float(math.sqrt(max(0.0, w @ self.cov @ w)))

    def wald(self, restrictions: Sequence[Mapping[tuple[str, str], float]], values: Sequence[float] = ()) -> tuple[float, int, float]:
        """(statistic, degrees, p) of weighted sums of coefficients being values, or zero, all together."""
        r = np.zeros((len(restrictions), len(self.cov)))
        for row, weights in zip(r, restrictions, strict=True):
            for (term, left), value in weights.items():
                row[self.at(term, left)] = value
        gap = r @ self.coef.T.ravel() - (np.asarray(values, dtype=float) if len(values) else 0.0)
        statistic = float(gap @ np.linalg.solve(r @ self.cov @ r.T, gap))
        return statistic, len(r), upper_chi_square(statistic, len(r))

    def criteria(self) -> dict[str, float]:
        """Normal log likelihood and information criteria a row."""
        m, free, n = len(self.left), self.coef.size, self.n
        spread = float(np.linalg.slogdet(self.sigma)[1])
        return {
            "log_likelihood": -0.5 * n * (spread + m * (1 + math.log(2 * math.pi))),
            "aic": spread + 2 * free / n,
            "bic": spread + math.log(n) * free / n,
            "hqc": spread + 2 * math.log(math.log(n)) * free / n,
        }


def system_regression(df: DataFrame, left: Sequence[str], right: Sequence[str], robust: bool = True, intercept: bool = True) -> SystemFit:
    """Least squares of several left sides on the same terms over the rows that are complete for all.

    All second moments of both sides are one aggregation. The covariance across equations is that of
    the residuals times the inverse moments, or, if robust, from the products of residuals and terms,
    which are a second aggregation. Only numbers of the size of the coefficients reach the driver.
    """
    terms = [*(["Intercept"] if intercept else []), *right]
    k, m = len(terms), len(left)
    columns = [F.lit(1.0) if t == "Intercept" else term_column(t) for t in terms] + [term_column(y) for y in left]
    rows = df.select(*(c.alias(f"_x{i}") for i, c in enumerate(columns)))
    for i in range(k + m):
        rows = rows.where(finite(F.col(f"_x{i}")))
    centre = rows.agg(F.count(F.lit(1)), *(F.avg(f"_x{i}") for i in range(k + m))).first()
    n = centre[0]
    if n <= k:
        raise ValueError("not more complete rows than terms")
    shift = [0.0 if t == "Intercept" or not intercept else float(centre[i + 1]) for i, t in enumerate([*terms, *left])]
    moved = rows.select(*((F.col(f"_x{i}") - F.lit(s)).alias(f"_x{i}") for i, s in enumerate(shift)))
    gram = symmetric_sum(moved, k + m, F.lit(1.0))
    inverse = np.linalg.inv(gram[:k, :k])
    coef = inverse @ gram[:k, k:]
    sigma = (gram[k:, k:] - coef.T @ gram[:k, k:]) / n
    cov = np.kron(sigma, inverse)
    if robust:
        residual = [F.col(f"_x{k + j}") - sum((F.lit(float(coef[i, j])) * F.col(f"_x{i}") for i in range(k)), F.lit(0.0)) for j in range(m)]
        scores = moved.select(*((residual[j] * F.col(f"_x{i}")).alias(f"_x{j * k + i}") for j in range(m) for i in range(k)))
        bread = np.kron(np.eye(m), inverse)
        cov = bread @ symmetric_sum(scores, m * k, F.lit(1.0)) @ bread
    if intercept:  # back from the centred columns
        back = np.eye(k)
        back[0, 1:] = -np.array(shift[1:k])
        coef = back @ coef
        coef[0] += shift[k:]
        whole = np.kron(np.eye(m), back)
        cov = whole @ cov @ whole.T
    return SystemFit(list(left), terms, coef, (sigma + sigma.T) / 2, (cov + cov.T) / 2, n)


def sum_of_coefficients(fit: Fit, terms: Sequence[str]) -> tuple[float, float]:
    """The sum of some coefficients of one regression and its standard error."""
    return fit.combination(dict.fromkeys(terms, 1.0))


@dataclass(frozen=True)
class CorrectionSystem:
    """Changes of variables on the lagged gaps from their long-run relations and on lagged changes."""

    variables: list[str]
    relations: np.ndarray  # relation by variable
    levels: np.ndarray
    fit: SystemFit
    lags: int

    def companion(self) -> np.ndarray:
        """The transition of (changes and their lags, gaps): a gap moves by its relation of the changes."""
        m, r = len(self.variables), len(self.relations)
        pull, moves = self.fit.coef[1 : 1 + r].T, self.fit.coef[1 + r :].T
        size = m * max(self.lags, 1)
        out = np.zeros((size + r, size + r))
        out[:m, : m * self.lags], out[:m, size:] = moves, pull
        if self.lags > 1:
            out[m:size, : size - m] = np.eye(size - m)
        out[size:] = self.relations @ out[:m]
        out[size:, size:] += np.eye(r)
        return out

    def responses(self, periods: int, impact: np.ndarray | None = None) -> np.ndarray:
        """Levels' responses: period, variable, shock. impact: variables by shocks; by default the
        orthogonal shocks in the order of the variables."""
        m, step = len(self.variables), self.companion()
        impact = np.linalg.cholesky(self.fit.sigma) if impact is None else np.asarray(impact, dtype=float)
        state = np.zeros((len(step), impact.shape[1]))
        state[:m] = impact
        state[len(step) - len(self.relations) :] = self.relations @ impact
        out, level = [], np.zeros_like(impact)
        for _ in range(periods):
            level = level + state[:m]
            out.append(level)
            state = step @ state
        return np.array(out)


def long_run(df: DataFrame, left: str, right: Sequence[str], lags: int, order: Sequence[str]) -> tuple[dict[str, float], float]:
    """({variable: weight}, level) of a long-run relation, one for the left side, by leads and lags of the right sides' changes."""
    w = ordered((), order)
    around = [(i, x) for i in range(-lags, lags + 1) for x in right]
    rows = df.withColumns({f"_d_{x}": F.col(x) - F.lag(x).over(w) for x in right})
    rows = rows.withColumns({f"_d{i + lags}_{x}": shifted(F.col(f"_d_{x}"), i, w) for i, x in around})
    fit = system_regression(rows, [left], [*right, *(f"_d{i + lags}_{x}" for i, x in around)], robust=False)
    return {left: 1.0} | {x: -float(fit.coef[1 + i, 0]) for i, x in enumerate(right)}, float(fit.coef[0, 0])


def error_correction_system(df: DataFrame, variables: Sequence[str], relations: Sequence[tuple[str, Sequence[str]]], lags: int, order: Sequence[str], dls_lags: int = 2) -> CorrectionSystem:
    """An error-correction system with one or several long-run relations (left side, right sides).

    Each relation is found by dynamic least squares; all changes are then regressed on all lagged gaps
    and on lagged changes in one pass of moments. One series is in one order, so its lags are one
    window; the moments are sums. The series is read once and kept until all is fitted.
    """
    df = df.select(*dict.fromkeys([*order, *variables])).persist()
    try:
        return corrected(df, variables, relations, lags, order, dls_lags)
    finally:
        df.unpersist()


def corrected(df: DataFrame, variables: Sequence[str], relations: Sequence[tuple[str, Sequence[str]]], lags: int, order: Sequence[str], dls_lags: int) -> CorrectionSystem:
    weights, levels = np.zeros((len(relations), len(variables))), np.zeros(len(relations))
    for row, (left, right) in enumerate(relations):
        found, levels[row] = long_run(df, left, right, dls_lags, order)
        for x, value in found.items():
            weights[row, list(variables).index(x)] = value
    w = ordered((), order)
    gaps = {f"_gap{r}": F.lag(sum((F.lit(float(b)) * F.col(x) for b, x in zip(weights[r], variables, strict=True)), F.lit(-float(levels[r])))).over(w) for r in range(len(relations))}
    rows = df.withColumns(gaps).withColumns({f"D_{x}": F.col(x) - F.lag(x).over(w) for x in variables})
    for x in variables if lags else ():
        rows = add_lags(rows, f"D_{x}", range(1, lags + 1), order)
    right = [*gaps, *(f"L{i}_D_{x}" for i in range(1, lags + 1) for x in variables)]
    return CorrectionSystem(list(variables), weights, levels, system_regression(rows, [f"D_{x}" for x in variables], right), lags)


@dataclass(frozen=True)
class LongHorizon:
    """What a vector autoregression implies for sums over a horizon, the first variable on the others."""

    variables: list[str]
    now: np.ndarray  # covariance of the variables
    ahead: np.ndarray  # covariance of the variables' sums over the next horizon with the variables now
    sums: np.ndarray  # covariance of sums over the horizon
    horizon: int

    def predictive(self) -> list[tuple[str, float, float]]:
        """(variable, coefficient, R2) of the first variable's sum ahead on each other one alone."""
        return [(x, float(self.ahead[0, i] / self.now[i, i]), float(self.ahead[0, i] ** 2 / (self.sums[0, 0] * self.now[i, i]))) for i, x in enumerate(self.variables) if i]

    def contemporaneous(self) -> tuple[np.ndarray, float]:
        """Coefficients of the first variable's sum on the others' sums, and R2."""
        coef = np.linalg.solve(self.sums[1:, 1:], self.sums[1:, 0])
        return coef, float(coef @ self.sums[1:, 0] / self.sums[0, 0])

    def orthogonal(self) -> list[tuple[str, float, float]]:
        """(variable, coefficient, R2 that it adds), each other variable less what those before it explain."""
        root = np.linalg.cholesky(self.sums[1:, 1:])
        against = np.linalg.solve(root, self.sums[1:, 0])
        scale = np.diag(root)
        return [(x, float(b / s), float(b * b / self.sums[0, 0])) for x, b, s in zip(self.variables[1:], against, scale, strict=True)]

    def variance_ratios(self) -> dict[str, float]:
        """The variance of each variable's sum over so many times its own: above one where it builds up."""
        return {x: float(self.sums[i, i] / (self.horizon * self.now[i, i])) for i, x in enumerate(self.variables)}


def long_horizon_system(fit: VectorFit, horizon: int) -> LongHorizon:
    """Covariances of sums from a fitted vector autoregression's companion form."""
    m, a = len(fit.variables), fit.companion()
    shock = np.zeros_like(a)
    shock[:m, :m] = fit.sigma
    if np.abs(np.linalg.eigvals(a)).max() >= 1:
        raise ArithmeticError("the autoregression is not stable")
    total, power, more = shock, a, shock  # sum of a^j shock a'^j by doubling
    while np.abs(more).max() > 1e-16 * np.abs(total).max():
        more = power @ total @ power.T
        total, power = total + more, power @ power
    ahead, sums, lagged = np.zeros_like(a), horizon * total, total
    for j in range(1, horizon + 1):
        lagged = a @ lagged
        ahead = ahead + lagged
        sums = sums + (horizon - j) * (lagged + lagged.T)
    return LongHorizon(list(fit.variables), total[:m, :m], ahead[:m, :m], sums[:m, :m], horizon)


def sum_on_sums(df: DataFrame, y: str, xs: Sequence[str], horizon: int, order: Sequence[str], lags: int | None = None) -> Fit:
    """The sum of y over horizon rows up to each on the sums of xs over the same, errors of horizon - 1 lags."""
    w = ordered((), order)
    made = {f"S_{c}": sum((F.lag(c, i).over(w) for i in range(1, horizon)), F.col(c)) for c in (y, *xs)}
    return regression(df.withColumns(made), f"S_{y} ~ {' + '.join(f'S_{x}' for x in xs)}", hac_lags=horizon - 1 if lags is None else lags, order=order)


Moments = Callable[[np.ndarray], Sequence[Column]]
Jacobian = Callable[[np.ndarray], Sequence[Sequence[Column]]]
Hessians = Callable[[np.ndarray], Sequence[Sequence[Sequence[Column]]]]


@dataclass(frozen=True)
class MomentFit:
    """Parameters that bring mean moments closest to zero, their covariance, and the test of the moments left over."""

    params: np.ndarray
    cov: np.ndarray
    moments: np.ndarray
    jacobian: np.ndarray
    variance: np.ndarray
    weights: np.ndarray
    objective: float
    j_statistic: float
    j_p: float
    n: int
    steps: int


def mean_moments(df: DataFrame, at: Sequence[np.ndarray], moments: Moments) -> tuple[np.ndarray, int]:
    """Mean moments at several parameters (parameters by moments) and the rows, in one aggregation."""
    columns = [m for p in at for m in moments(p)]
    row = df.agg(F.count(F.lit(1)), *(F.avg(c.cast("double")).alias(f"_g{i}") for i, c in enumerate(columns))).first()
    if not row[0]:
        raise ValueError("no rows")
    return np.array([float("nan") if v is None else v for v in row[1:]]).reshape(len(at), -1), row[0]


def mean_jacobian(df: DataFrame, at: np.ndarray, moments: Moments, jacobian: Jacobian | None, step: float = 1e-6) -> np.ndarray:
    """Moments by parameters, from the given derivatives or by differences, in one aggregation."""
    if jacobian is not None:
        cells = [c for row in jacobian(at) for c in row]
        got = df.agg(*(F.avg(c.cast("double")).alias(f"_d{i}") for i, c in enumerate(cells))).first()
        return np.array(list(got)).reshape(-1, len(at))
    width = step * np.maximum(1.0, np.abs(at))
    around = [at + s * width[i] * np.eye(len(at))[i] for i in range(len(at)) for s in (1, -1)]
    got, _ = mean_moments(df, around, moments)
    return ((got[0::2] - got[1::2]) / (2 * width[:, None])).T


def moment_variance(df: DataFrame, at: np.ndarray, moments: Moments, lags: int = 0, order: Sequence[str] = ()) -> np.ndarray:
    """Mean products of the moments of a row, and of rows up to lags apart in order with falling weights."""
    columns = moments(at)
    rows = df.select(*(c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)))
    k, n = len(columns), rows.count()
    out = symmetric_sum(rows, k, F.lit(1.0))
    if lags:
        from tallyloom.operators.regression import lagged_scores

        keys = [f"_o{i}" for i in range(len(order))]
        shown = lagged_scores(rows.select(*keys, *(F.col(f"_x{i}").alias(f"_u{i}") for i in range(k))), keys, k, lags, n)
        sums = shown.agg(*(F.coalesce(F.sum(F.col(f"_u{a}") * F.col(f"_l{b}_{j}")), F.lit(0.0)).alias(f"_m{j}_{a}_{b}") for j in range(1, lags + 1) for a in range(k) for b in range(k))).first()
        for j, part in enumerate(np.array(list(sums)).reshape(lags, k, k), 1):
            out = out + (1 - j / (lags + 1)) * (part + part.T)
    return out / n


def least_moments(df: DataFrame, start: np.ndarray, moments: Moments, weights: np.ndarray, jacobian: Jacobian | None = None, hessians: Hessians | None = None, steps: int = 100, tolerance: float = 1e-10) -> tuple[np.ndarray, int]:
    """(parameters, steps) that make half of g' W g least, g the mean moments.

    A step is Newton's where second derivatives are given and the curvature is positive, else Gauss and
    Newton's. Eight lengths of a step are tried in one aggregation, so a step reads the rows two or
    three times whatever its length.
    """
    at = np.asarray(start, dtype=float)
    for step in range(1, steps + 1):
        g = mean_moments(df, [at], moments)[0][0]
        d = mean_jacobian(df, at, moments, jacobian)
        slope, curve = d.T @ weights @ g, d.T @ weights @ d
        if hessians is not None:
            cells = [c for i in hessians(at) for row in i for c in row]
            got = df.agg(*(F.avg(c.cast("double")).alias(f"_h{i}") for i, c in enumerate(cells))).first()
            full = curve + np.einsum("i,ijk->jk", weights @ g, np.array(list(got)).reshape(len(g), len(at), len(at)))
            curve = full if np.linalg.eigvalsh((full + full.T) / 2).min() > 0 else curve
        move = -np.linalg.lstsq(curve, slope, rcond=None)[0]
        tried = [at + move / 2**i for i in range(8)]
        there, _ = mean_moments(df, tried, moments)
        cost = [float(v @ weights @ v) if np.isfinite(v).all() else math.inf for v in there]
        best = int(np.argmin(cost))
        if not cost[best] < g @ weights @ g:
            return at, step
        moved = np.abs(tried[best] - at)
        at = tried[best]
        if (moved <= tolerance * np.maximum(1.0, np.abs(at))).all():
            return at, step
    raise ArithmeticError(f"moments did not settle in {steps} steps")


def moment_estimator(
    df: DataFrame,
    start: Sequence[float],
    moments: Moments,
    jacobian: Jacobian | None = None,
    hessians: Hessians | None = None,
    weights: np.ndarray | None = None,
    rounds: int = 2,
    lags: int = 0,
    order: Sequence[str] = (),
) -> MomentFit:
    """Generalised method of moments over all rows, which are only ever summed.

    moments(p): a column for each moment of a row; jacobian(p): its derivatives, moments by
    parameters, by differences if left out; hessians(p): second derivatives, moments by parameters by
    parameters. The first round has the weights given, or equal ones; each further round the inverse
    of the moments' variance at the last parameters. The covariance allows for the weights used;
    j_statistic tests the moments beyond the parameters (p is 1 without any).
    """
    params = np.asarray(start, dtype=float)
    w = np.eye(len(moments(params))) if weights is None else np.asarray(weights, dtype=float)
    steps = 0
    for r in range(rounds):
        if r:
            w = np.linalg.inv(moment_variance(df, params, moments, lags, order))
        params, taken = least_moments(df, params, moments, w, jacobian, hessians)
        steps += taken
    (g,), n = mean_moments(df, [params], moments)
    d, s = mean_jacobian(df, params, moments, jacobian), moment_variance(df, params, moments, lags, order)
    bread = np.linalg.inv(d.T @ w @ d)
    cov = bread @ d.T @ w @ s @ w @ d @ bread / n
    j, over = float(n * g @ np.linalg.solve(s, g)), len(g) - len(params)
    return MomentFit(params, (cov + cov.T) / 2, g, d, s, w, float(0.5 * g @ w @ g), j, upper_chi_square(j, over) if over > 0 else 1.0, n, steps)
