"""Small dense kernels for the driver or a task: linear algebra, quadrature, roots, Chebyshev tensors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np

from tallyloom.functions.numerics import normal_z


def normal_band(p: float) -> tuple[float, float]:
    """The central interval of a standard normal variable with probability p."""
    z = normal_z(p)
    return -z, z


def clipped_factor(a: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """A factor L with L L' = a, a symmetric; eigenvalues below least are raised to it."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    return vectors * np.sqrt(np.maximum(values, least))


def column_factor(a: np.ndarray) -> np.ndarray:
    """Lower Cholesky factor, a column at a time; columns without variance left are zero."""
    rest, out = np.array(a, dtype=float), np.zeros_like(a, dtype=float)
    for k in range(len(rest)):
        if rest[k, k] > 0:
            out[k:, k] = rest[k:, k] / np.sqrt(rest[k, k])
            rest[k:, k:] -= np.outer(out[k:, k], out[k:, k])
    return out


def normal_draws(covariance: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n draws (rows) of normal variables with this covariance."""
    return np.random.default_rng(seed).standard_normal((n, len(covariance))) @ clipped_factor(np.asarray(covariance, dtype=float)).T


def quadratic_form(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return a.T @ x @ a


def solve_right(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The x with x a = b."""
    return np.linalg.solve(a.T, b.T).T


def pseudo_inverse(a: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """Inverse on the singular directions whose singular value is at least least."""
    left, values, right = np.linalg.svd(a, full_matrices=False)
    kept = values >= least
    return (right[kept].T / values[kept]) @ left[:, kept].T


def hessian(f: Callable[[np.ndarray], float], x: np.ndarray, step: float = 1e-4) -> np.ndarray:
    """Second derivatives by central differences."""
    x = np.asarray(x, dtype=float)
    moves = np.diag(step * np.maximum(1.0, np.abs(x)))
    out = np.empty((len(x), len(x)))
    for i, a in enumerate(moves):
        for j, b in enumerate(moves[: i + 1]):
            corners = f(x + a + b) - f(x + a - b) - f(x - a + b) + f(x - a - b)
            out[i, j] = out[j, i] = corners / (4 * a[i] * b[j])
    return out


def gauss_legendre(n: int, low: float = -1.0, high: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of an integral from low to high."""
    x, w = np.polynomial.legendre.leggauss(n)
    return (high - low) / 2 * x + (high + low) / 2, (high - low) / 2 * w


def secant_root(f: Callable[[float], float], x0: float, x1: float, tolerance: float = 1e-6, steps: int = 1000) -> float:
    """A root by secants; a step that makes the residual larger is halved."""
    f0, f1 = f(x0), f(x1)
    for _ in range(steps):
        if abs(f1) < tolerance:
            return x1
        if f1 == f0:
            break
        move = -f1 * (x1 - x0) / (f1 - f0)
        x2, f2 = x1 + move, f(x1 + move)
        while not abs(f2) < 2 * abs(f1) and abs(move) > 1e-14:
            move /= 2
            x2, f2 = x1 + move, f(x1 + move)
        x0, f0, x1, f1 = x1, f1, x2, f2
    raise ArithmeticError("no root was reached")


def chebyshev_basis(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n Chebyshev polynomials at x (rows), and their derivatives."""
    x = np.atleast_1d(np.asarray(x, dtype=float))
    basis = np.polynomial.chebyshev.chebvander(x, n - 1)
    slopes = np.column_stack([np.polynomial.chebyshev.chebval(x, np.polynomial.chebyshev.chebder(row)) for row in np.eye(n)])
    return basis, slopes


def tensor_basis(points: np.ndarray, orders: Sequence[int]) -> np.ndarray:
    """Products of the polynomials of each dimension at points (rows), the last dimension's running fastest."""
    bases = [chebyshev_basis(points[:, d], n)[0] for d, n in enumerate(orders)]
    return reduce(lambda a, b: (a[:, :, None] * b[:, None, :]).reshape(len(points), -1), bases)


class TensorFit:
    """A function of several variables on a box as a sum of tensor products of Chebyshev polynomials."""

    def __init__(self, orders: Sequence[int], low: Sequence[float] | float = -1.0, high: Sequence[float] | float = 1.0):
        self.orders = tuple(orders)
        self.low, self.high = (np.broadcast_to(np.asarray(x, dtype=float), (len(self.orders),)) for x in (low, high))
        self.coefficients = np.zeros(int(np.prod(self.orders)))

    def to_unit(self, points: np.ndarray) -> np.ndarray:
        return 2 * (np.atleast_2d(points) - self.low) / (self.high - self.low) - 1

    def nodes(self) -> np.ndarray:
        """The grid of Chebyshev nodes in the box, a row a point."""
        lines = [-np.cos((2 * np.arange(1, n + 1) - 1) * np.pi / (2 * n)) for n in self.orders]
        unit = np.stack(np.meshgrid(*lines, indexing="ij"), axis=-1).reshape(-1, len(lines))
        return (unit + 1) / 2 * (self.high - self.low) + self.low

    def fit(self, values: np.ndarray, points: np.ndarray | None = None) -> TensorFit:
        """Coefficients from values at the nodes, or by least squares at other points."""
        basis = tensor_basis(self.to_unit(self.nodes() if points is None else points), self.orders)
        self.coefficients = np.linalg.lstsq(basis, values, rcond=None)[0]
        return self

    def __call__(self, points: np.ndarray, rows: int = 10_000) -> np.ndarray:
        unit = self.to_unit(points)
        return np.concatenate([tensor_basis(unit[a : a + rows], self.orders) @ self.coefficients for a in range(0, len(unit), rows)])
