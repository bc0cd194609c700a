"""Small matrices in batches: the leading axis runs over systems."""

from __future__ import annotations

import numpy as np


def expm(a: np.ndarray, terms: int = 16) -> np.ndarray:
    """Matrix exponentials by scaling, a Taylor polynomial and squaring."""
    norm = max(float(np.abs(a).sum(axis=-1).max(initial=0.0)), 1e-300)
    s = max(0, int(np.ceil(np.log2(norm))) + 1)
    x = a / 2.0**s
    out = term = np.broadcast_to(np.eye(a.shape[-1]), a.shape)
    for k in range(1, terms + 1):
        term = term @ x / k
        out = out + term
    for _ in range(s):
        out = out @ out
    return out


def lyapunov(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """X with a X + X a' + q = 0."""
    n = a.shape[-1]
    eye = np.eye(n)
    left = np.einsum("ij,...kl->...ikjl", eye, a) + np.einsum("...ij,kl->...ikjl", a, eye)
    return np.linalg.solve(left.reshape(*a.shape[:-2], n * n, n * n), -q.reshape(*q.shape[:-2], n * n, 1)).reshape(q.shape)


def discretize(a: np.ndarray, q: np.ndarray, c: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition, noise and intercept over dt of the system with drift a, diffusion q and intercept c; a is stable."""
    step = expm(a * dt)
    rest = lyapunov(a, q)
    noise = rest - step @ rest @ np.swapaxes(step, -1, -2)
    shift = np.linalg.solve(a, (step - np.eye(a.shape[-1])) @ c[..., None])[..., 0]
    return step, (noise + np.swapaxes(noise, -1, -2)) / 2, shift


def steady(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return -np.linalg.solve(a, c[..., None])[..., 0]


def held(a: np.ndarray, c: np.ndarray, j: int, value: np.ndarray) -> np.ndarray:
    """Steady state while variable j is held at a value."""
    left, right = a.copy(), -c.copy()
    left[..., j, :] = np.eye(a.shape[-1])[j]
    right[..., j] = value
    return np.linalg.solve(left, right[..., None])[..., 0]


def effect(a: np.ndarray, c: np.ndarray, j: int, outcome: int) -> np.ndarray:
    """Change of the outcome's steady state when variable j is held one above its own."""
    base = steady(a, c)
    return held(a, c, j, base[..., j] + 1)[..., outcome] - base[..., outcome]
