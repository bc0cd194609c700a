"""Random draws as columns. A draw is a function of a key, a name and a place, so that it is the same on every run, on every
machine and in any order, and needs no generator: uniform numbers are digits of a hash."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attempts of methods that reject: the chance that one fails is a few in a hundred at most.
ATTEMPTS = 64


def uniform(key: Column, name: str, at: Column | int = 0, slot: int = 0) -> Column:
    """Between 0 and 1, neither included."""
    where = F.concat_ws("|", key.cast("string"), F.lit(name), (at if isinstance(at, Column) else F.lit(at)).cast("string"), F.lit(str(slot)))
    return (F.conv(F.substring(F.md5(where), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def standard(key: Column, name: str, at: Column | int = 0) -> Column:
    """Standard normal, from two uniform numbers."""
    return F.sqrt(-2 * F.ln(uniform(key, name, at, 1))) * F.cos(2 * pi * uniform(key, name, at, 2))


def normal(key: Column, name: str, mu: float, sigma: float) -> Column:
    return F.lit(float(mu)) + float(sigma) * standard(key, name)


def half_normal(key: Column, name: str, sigma: float) -> Column:
    return F.abs(float(sigma) * standard(key, name))


def first(attempt: Callable[[Column], Column], otherwise: Column) -> Column:
    """The first attempt that is not null; later ones are not computed."""
    none = F.lit(None).cast("double")
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), none, lambda found, i: F.coalesce(found, attempt(i))), otherwise)


def truncated(key: Column, name: str, mu: float, sigma: float, lower: float, upper: float) -> Column:
    """Normal between bounds. Where ATTEMPTS normal draws all miss them, a uniform number between them."""

    def attempt(i: Column) -> Column:
        x = F.lit(float(mu)) + float(sigma) * standard(key, name, i)
        return F.when(x.between(float(lower), float(upper)), x)

    return first(attempt, float(lower) + (float(upper) - float(lower)) * uniform(key, name))


def gamma(key: Column, name: str, shape: float, rate: float) -> Column:
    """By squeezing a cubed normal number; shapes under 1 by a power of a uniform one."""
    a = shape if shape >= 1 else shape + 1
    d = a - 1 / 3

    def attempt(i: Column) -> Column:
        x = standard(key, name, i)
        v = F.pow(1 + x / (9 * d) ** 0.5, F.lit(3.0))
        keeps = (v > 0) & (F.ln(uniform(key, name, i)) < 0.5 * x * x + d - d * v + d * F.ln(F.greatest(v, F.lit(1e-300))))
        return F.when(keeps, d * v)

    small = F.lit(1.0) if shape >= 1 else F.pow(uniform(key, name, ATTEMPTS), F.lit(1 / shape))
    return first(attempt, F.lit(d)) * small / rate
