"""Points and weights that integrate functions against the standard normal density."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Tensor rules with more points give way to the unscented one.
MOST = 2_000


def gauss_hermite(points: int) -> tuple[np.ndarray, np.ndarray]:
    """(points,), (points,): exact for polynomials of degree under 2 * points."""
    x, w = np.polynomial.hermite.hermgauss(points)
    return x * np.sqrt(2), w / np.sqrt(np.pi)


def tensor(points: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(points ** dim, dim), (points ** dim,): the product rule."""
    x, w = gauss_hermite(points)
    return np.stack([g.ravel() for g in np.meshgrid(*[x] * dim, indexing="ij")], axis=1), np.prod(np.meshgrid(*[w] * dim, indexing="ij"), axis=0).ravel()


def unscented(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(2 * dim + 1, dim), (2 * dim + 1,): the centre with half the weight and a pair of points on each axis; mean and
    covariance are exact."""
    arm = np.sqrt(2 * dim) * np.eye(dim)
    return np.concatenate([np.zeros((1, dim)), arm, -arm]), np.array([0.5] + [0.25 / dim] * (2 * dim))


@lru_cache(64)
def rule(dim: int, points: int, kind: str = "gauss_hermite") -> tuple[np.ndarray, np.ndarray]:
    if kind not in ("gauss_hermite", "unscented"):
        raise ValueError(f"unknown rule: {kind}")
    return tensor(points, dim) if kind == "gauss_hermite" and points**dim <= MOST else unscented(dim)
