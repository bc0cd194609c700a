"""Log-densities of measurement families with their slopes and curvatures in the predictor, as numpy arrays.

The same seven families as `emissions`, which gives densities as columns, and `sampling`, which draws from them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import lgamma, log, pi

import numpy as np

#: Fixed values where a model says nothing: degrees of freedom, shape, dispersion, precision.
DEFAULTS = {"df": 5.0, "shape": 1.0, "r": 5.0, "phi": 10.0}
FAMILIES = ("gaussian", "student_t", "poisson", "gamma", "bernoulli", "neg_binomial", "beta")
#: Predictors are held below this where a link takes their exponential.
FAR = 50.0
#: Up to this many numbers are faster one by one than as an array.
FEW = 256


def gammas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of the gamma function of x > 0, and its first and second derivative: moved up to 10 or more, where the asymptotic
    series are exact to double precision."""
    x = np.asarray(x, float)
    low, first, second = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    for _ in range(10):
        small = x < 10
        at = np.where(small, x, 1.0)
        low, first, second = low - np.log(at), first - small / at, second + small / at**2
        x = x + small
    i = 1 / x**2
    low = low + (x - 0.5) * np.log(x) - x + 0.5 * log(2 * pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / x
    first = first + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))
    second = second + (1 + 0.5 / x + i * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i * (1 / 30 - i * 5 / 66))))) / x
    return low, first, second


def log_gamma(x) -> np.ndarray:
    """Of x > 0; few numbers one by one."""
    x = np.asarray(x, float)
    return np.array([lgamma(v) for v in x.ravel().tolist()]).reshape(x.shape) if x.size <= FEW else gammas(x)[0]


def constant(family: str, y, df=5.0, shape=1.0, r=5.0, phi=10.0) -> np.ndarray | float:
    """What of a log-density is made of gamma functions that no predictor changes."""
    if family == "student_t":
        return log_gamma((np.asarray(df) + 1) / 2) - log_gamma(np.asarray(df) / 2)
    if family == "beta":
        return log_gamma(phi)
    if family == "gamma":
        return -log_gamma(shape)
    if family in ("poisson", "neg_binomial"):
        y = np.maximum(y, 0.0)
        return -log_gamma(y + 1.0) if family == "poisson" else log_gamma(y + r) - log_gamma(r) - log_gamma(y + 1.0)
    return 0.0


def scores(family: str, y, eta: np.ndarray, sd=1.0, df=5.0, shape=1.0, r=5.0, phi=10.0, rest=None, only: bool = False) -> tuple[np.ndarray, ...]:
    """(log-density, slope, curvature, information) of one observation, or one for each entry of the first axis, at many
    predictors. Curvature is minus the second derivative and may be negative; information is its mean over observations. An
    observation that a family cannot give has log-density -inf; a gamma with y = 0 has one only for shape 1, a beta none at
    0 and 1. rest: from `constant`, where it is at hand. only: the log-density and nothing else."""
    eta, y = np.asarray(eta, float), np.asarray(y, float)
    one = 1.0 if only else np.ones_like(eta)
    if family == "gaussian":
        w = one / np.square(sd)
        dens = -0.5 * (y - eta) ** 2 * w + 0.5 * np.log(w) - 0.5 * log(2 * pi)
        return (dens,) if only else (dens, (y - eta) * w, w, w)
    rest = constant(family, y, df, shape, r, phi) if rest is None else rest
    if family == "student_t":
        z, s2 = y - eta, np.square(sd) * one
        q = df * s2 + z**2
        dens = rest - 0.5 * np.log(df * pi * s2) - (df + 1) / 2 * np.log1p(z**2 / (df * s2))
        if only:
            return (dens,)
        return dens, (df + 1) * z / q, (df + 1) * (df * s2 - z**2) / q**2, (df + 1) / ((df + 3) * s2)
    if family == "bernoulli":
        p = 1 / (1 + np.exp(-np.clip(eta, -FAR, FAR)))
        dens = np.where((y >= 0) & (y <= 1), -y * np.logaddexp(0, -eta) - (1 - y) * np.logaddexp(0, eta), -np.inf)
        if only:
            return (dens,)
        return dens, y - p, p * (1 - p), p * (1 - p)
    if family == "beta":
        p = 1 / (1 + np.exp(-np.clip(eta, -FAR, FAR)))
        a, b = np.maximum(phi * p, 1e-12), np.maximum(phi * (1 - p), 1e-12)
        (la, da, ta), (lb, db, tb) = gammas(a), gammas(b)
        slope = phi * p * (1 - p)
        info = slope**2 * (ta + tb)
        fine = (y > 0) & (y < 1)
        at = np.where(fine, y, 0.5)
        pull = np.log(at / (1 - at)) - da + db
        dens = rest - la - lb + (a - 1) * np.log(at) + (b - 1) * np.log(1 - at)
        return np.where(fine, dens, -np.inf), np.where(fine, slope * pull, 0.0), np.where(fine, info - slope * (1 - 2 * p) * pull, 0.0), info
    if family == "gamma":
        ratio = y * np.exp(-np.maximum(eta, -FAR))
        own = np.where(y > 0, (shape - 1) * np.log(np.where(y > 0, y, 1.0)), 0.0)
        none = (y < 0) | ((y == 0) & np.any(np.asarray(shape) != 1))
        dens = np.where(none, -np.inf, shape * (np.log(shape) - eta) + rest + own - shape * ratio)
        if only:
            return (dens,)
        return dens, shape * (ratio - 1), shape * ratio, shape * one
    mu = np.exp(np.minimum(eta, FAR))
    if family == "poisson":
        dens = np.where(y >= 0, y * eta - mu + rest, -np.inf)
        return (dens,) if only else (dens, y - mu, mu, mu)
    if family == "neg_binomial":
        part = mu / (r + mu)
        dens = np.where(y >= 0, rest - r * np.log1p(mu / r) + y * np.log(part + 1e-10), -np.inf)
        if only:
            return (dens,)
        return dens, r * (y - mu) / (r + mu), (y + r) * r * mu / (r + mu) ** 2, r * part
    raise ValueError(f"unknown family: {family}; there are {', '.join(FAMILIES)}")


def start(family: str, y: float) -> float:
    """A predictor near which an observation is likely."""
    if family in ("poisson", "neg_binomial", "gamma"):
        return log(max(y, 0.0) + 0.5)
    if family in ("bernoulli", "beta"):
        p = min(max(y, 0.1), 0.9)
        return log(p / (1 - p))
    return y


@dataclass
class Emissions:
    """A family for each channel, and what shapes it: arrays (systems or 1, channels) by name, defaults where not given."""

    families: list[str]
    shapes: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if unknown := set(self.families) - set(FAMILIES):
            raise ValueError(f"unknown family: {', '.join(sorted(unknown))}; there are {', '.join(FAMILIES)}")
        self.shapes = {k: np.atleast_2d(np.asarray(v, float)) for k, v in self.shapes.items()}

    @property
    def normal(self) -> np.ndarray:
        return np.array([f == "gaussian" for f in self.families], bool)

    def of(self, channels: list[int]) -> Emissions:
        return Emissions([self.families[j] for j in channels], {k: v[:, channels] for k, v in self.shapes.items()})

    def rest(self, j: int, y: np.ndarray) -> np.ndarray:
        """(observations, systems): `constant` of channel j, each observation's worked out once."""
        values, back = np.unique(y, return_inverse=True)
        own = constant(self.families[j], values[:, None], **{k: v[None, :, j] for k, v in self.shapes.items()})
        return np.broadcast_to(own, (len(values), np.shape(own)[1] if np.ndim(own) == 2 else 1))[back]

    def scores(self, j: int, y, eta: np.ndarray, sd: np.ndarray, rest: np.ndarray | None = None, only: bool = False) -> tuple[np.ndarray, ...]:
        """Those of channel j. eta: the systems on its first axis; sd: of each system, and y and rest may be as well."""
        fit = lambda v: np.reshape(v, (len(v),) + (1,) * (eta.ndim - 1)) if np.ndim(v) else v
        return scores(self.families[j], fit(y), eta, sd=fit(sd), **{k: fit(v[:, j]) for k, v in self.shapes.items()}, rest=None if rest is None else fit(rest), only=only)
