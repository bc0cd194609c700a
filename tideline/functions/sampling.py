"""Observations drawn from measurement families, as numpy arrays: what `emissions` gives the densities of."""

from __future__ import annotations

import numpy as np

#: Fixed values where a model says nothing: degrees of freedom, shape, dispersion, precision.
DF, SHAPE, DISPERSION, PRECISION = 5.0, 2.0, 5.0, 10.0
FAMILIES = ("gaussian", "student_t", "poisson", "gamma", "bernoulli", "neg_binomial", "beta")
FAR = 20.0


def draw(rng: np.random.Generator, family: str, loc: np.ndarray, sd: float | np.ndarray = 1.0, own: float | None = None) -> np.ndarray:
    """One observation for each predictor: log links for counts and gamma, logit links for bernoulli and beta. Predictors
    are held within FAR of zero where a link takes their exponential. own: what shapes the family beside its predictor."""
    own = own if own is not None and np.isfinite(own) else {"student_t": DF, "gamma": SHAPE, "neg_binomial": DISPERSION, "beta": PRECISION}.get(family)
    near = np.clip(loc, -FAR, FAR)
    mean, share = np.exp(near), 1 / (1 + np.exp(-near))
    if family == "gaussian":
        return loc + sd * rng.standard_normal(loc.shape)
    if family == "student_t":
        return loc + sd * rng.standard_t(own, loc.shape)
    if family == "poisson":
        return rng.poisson(mean).astype(float)
    if family == "gamma":
        return rng.gamma(own, mean / own)
    if family == "bernoulli":
        return (rng.random(loc.shape) < share).astype(float)
    if family == "neg_binomial":
        return rng.poisson(rng.gamma(own, mean / own)).astype(float)
    if family == "beta":
        return rng.beta(np.maximum(share * own, 1e-6), np.maximum((1 - share) * own, 1e-6))
    raise ValueError(f"unknown family: {family}; there are {', '.join(FAMILIES)}")
