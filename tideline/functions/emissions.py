"""Log-densities of measurement families as columns: y observed, eta the linear predictor. All stay in the JVM."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7: fixed values.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def lgamma(x: Column) -> Column:
    """Log of the gamma function for x > 0; Spark SQL has none."""
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:]):
        total = total + F.lit(c) / (x + k)
    t = x + 6.5
    return F.lit(0.5 * log(2 * pi)) + (x - 0.5) * F.ln(t) - t + F.ln(total)


def log_sigmoid(x: Column) -> Column:
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def gaussian(y: Column, eta: Column, sd: float = 1.0) -> Column:
    return -0.5 * F.pow((y - eta) / sd, 2) - log(sd) - 0.5 * log(2 * pi)


def poisson(y: Column, eta: Column) -> Column:
    return y * eta - F.exp(eta) - lgamma(y + 1)


def student_t(y: Column, eta: Column, df: float = 5.0, scale: float = 1.0) -> Column:
    z = F.pow((y - eta) / scale, 2)
    return lgamma(F.lit((df + 1) / 2)) - lgamma(F.lit(df / 2)) - 0.5 * log(df * pi) - log(scale) - (df + 1) / 2 * F.log1p(z / df)


def gamma(y: Column, eta: Column, shape: float = 1.0) -> Column:
    """Mean exp(eta)."""
    rate = shape / F.exp(eta)
    return shape * F.ln(rate) - lgamma(F.lit(shape)) + (shape - 1) * F.ln(y) - rate * y


def bernoulli(y: Column, eta: Column) -> Column:
    return y * log_sigmoid(eta) + (1 - y) * log_sigmoid(-eta)


def neg_binomial(y: Column, eta: Column, r: float = 5.0) -> Column:
    """Mean exp(eta)."""
    mu = F.exp(eta)
    return lgamma(y + r) - lgamma(F.lit(r)) - lgamma(y + 1) + r * F.ln(r / (r + mu)) + y * F.ln(mu / (r + mu) + 1e-10)


def beta(y: Column, eta: Column, phi: float = 10.0) -> Column:
    """Mean sigmoid(eta), precision phi."""
    a = phi / (1 + F.exp(-eta))
    b = phi - a
    return lgamma(F.lit(phi)) - lgamma(a) - lgamma(b) + (a - 1) * F.ln(y) + (b - 1) * F.ln(1 - y)


FAMILIES = {"gaussian": gaussian, "poisson": poisson, "student_t": student_t, "gamma": gamma, "bernoulli": bernoulli, "neg_binomial": neg_binomial, "beta": beta}


def log_density(family: str, y: Column, eta: Column, **how) -> Column:
    """Null where y is missing."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family: {family}")
    return FAMILIES[family](y, eta, **how)
