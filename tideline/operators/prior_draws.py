"""Systems drawn from their priors, one for each key, as columns: what `statespace.predictive` makes replicates of and
`priors.implied` looks at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import chance

#: Priors by kind (a centre makes a normal, bounds cut it off, a spread alone makes a half normal), gamma priors of
#: what shapes a family, and drift and diffusion of a latent variable that does not change.
PRIORS = {
    "drift": {"mu": -0.5, "sigma": 1.0}, "effect": {"mu": 0.0, "sigma": 0.5}, "diffusion": {"sigma": 1.0}, "cint": {"mu": 0.0, "sigma": 1.0}, "loading": {"mu": 0.5, "sigma": 0.5},
    "mean": {"mu": 0.0, "sigma": 2.0}, "noise": {"sigma": 1.0}, "start": {"mu": 0.0, "sigma": 2.0}, "start_sd": {"sigma": 2.0},
}
GAMMAS = {"student_t": (5.0, 1.0), "gamma": (2.0, 1.0), "neg_binomial": (2.0, 0.5), "beta": (5.0, 0.5)}
STILL = 1e-6


def drawn(key: Column, name: str, prior: dict[str, float]) -> Column:
    if "lower" in prior:
        return chance.truncated(key, name, prior["mu"], prior["sigma"], prior["lower"], prior["upper"])
    return chance.normal(key, name, prior["mu"], prior["sigma"]) if "mu" in prior else chance.half_normal(key, name, prior["sigma"])


def systems(
    keys: DataFrame, latents: list[str], effects: list[tuple[str, str]], channels: list[str], loadings: dict[tuple[str, str], float | None], still: tuple[str, ...] = (), means: tuple[str, ...] = (),
    families: list[str] | None = None, priors: dict[str, dict[str, float]] | None = None
) -> DataFrame:
    """A drawn system for each row of keys (draw): draw, drift, diffusion, loading (row by row), cint, mean, noise (sd of each
    channel), start, start_sd and shapes. effects: (cause, effect) that the drift may have, all else is zero; a variable's own
    drift is minus the size of its draw. loadings: (channel, latent) with a value, or None for a draw. still: variables that
    do not change. means: channels with a mean of their own. priors: by parameter or else by kind, over PRIORS. A null key
    gives no row; a key that repeats gives the same system again."""
    key, families = F.col("draw"), families or ["gaussian"] * len(channels)
    zero = F.lit(0.0)

    def value(kind: str, *names: str) -> Column:
        name = "_".join([kind, *names])
        return drawn(key, name, PRIORS[kind] | {} if priors is None else priors.get(name, priors.get(kind, PRIORS[kind])))

    def drift(row: str, col: str) -> Column:
        if row == col:
            return F.lit(-STILL) if row in still else -F.abs(value("drift", row))
        return value("effect", row, col) if (col, row) in effects else zero

    def load(channel: str, latent: str) -> Column:
        if (channel, latent) not in loadings:
            return zero
        own = loadings[channel, latent]
        return value("loading", channel, latent) if own is None else F.lit(float(own))

    spread = lambda x: F.lit(STILL) if x in still else value("diffusion", x)
    shape = lambda c, f: chance.gamma(key, f"shape_{c}", *GAMMAS[f]) if f in GAMMAS else F.lit(None).cast("double")
    return keys.where(key.isNotNull()).select(
        "draw", F.array(*[drift(r, c) for r in latents for c in latents]).alias("drift"), F.array(*[spread(r) if r == c else zero for r in latents for c in latents]).alias("diffusion"),
        F.array(*[load(c, x) for c in channels for x in latents]).alias("loading"), F.array(*[zero if x in still else value("cint", x) for x in latents]).alias("cint"),
        F.array(*[value("mean", c) if c in means else zero for c in channels]).alias("mean"), F.array(*[value("noise", c) if f in ("gaussian", "student_t") else zero for c, f in zip(channels, families)]).alias("noise"),
        F.array(*[value("start", x) for x in latents]).alias("start"), F.array(*[value("start_sd", x) for x in latents]).alias("start_sd"),
        F.array(*[shape(c, f) for c, f in zip(channels, families)]).alias("shapes"),
    )


def long_rows(systems_: DataFrame, of: dict[str, list[str]]) -> DataFrame:
    """(draw, param, value): entries of the arrays of `systems` by name, as `priors.value_checks` takes them. of: names of an
    array's entries, None for one that is left out."""
    rows = [F.struct(F.lit(name).alias("param"), F.col(array)[i].alias("value")) for array, names in of.items() for i, name in enumerate(names) if name is not None]
    return systems_.select("draw", F.explode(F.array(*rows)).alias("x")).select("draw", "x.*")
