"""Priors: brought to a mean and a spread, given by default, pooled over elicitations, and checked by what they imply."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import linear

#: A default's distribution and parameters by constraint, and by role where that decides.
BY_CONSTRAINT = {"positive": ("HalfNormal", {"sigma": 1.0}), "unit_interval": ("Beta", {"alpha": 2.0, "beta": 2.0}), "correlation": ("Uniform", {"lower": -1.0, "upper": 1.0})}
BY_ROLE = {"ar_coefficient": BY_CONSTRAINT["unit_interval"], "residual_sd": BY_CONSTRAINT["positive"]}
OTHERWISE, CONFIDENCE = ("Normal", {"mu": 0.0, "sigma": 0.5}), 0.3
#: Fixed values of the checks on prior draws.
NEGATIVE_SHARE, EXTREME_SHARE, EXTREME, SCALE_RATIO, UNSTABLE_SHARE = 0.05, 0.10, 1e6, 100.0, 0.5
MOST_COMPONENTS, FIT_ROUNDS = 3, 100


def normalised(distribution: Column, params: Column) -> Column:
    """struct(mu, sigma, lower, upper) of a distribution by name and its parameters (map of double); what a distribution
    does not have is null. Unknown names are read as normal."""
    name, p = F.lower(distribution), lambda key, default: F.coalesce(params[key], F.lit(float(default)))
    a, b, low, high = p("alpha", 2), p("beta", 2), p("lower", -1), p("upper", 1)
    none = F.lit(None).cast("double")
    made = lambda mu, sigma, lower=none, upper=none: F.struct(mu.alias("mu"), sigma.alias("sigma"), lower.alias("lower"), upper.alias("upper"))
    return (
        F.when(name == "halfnormal", made(none, p("sigma", 1)))
        .when(name == "beta", made(a / (a + b), F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))))
        .when(name == "uniform", made((low + high) / 2, (high - low) / 4, low, high))
        .otherwise(made(p("mu", 0), p("sigma", 1)))
    )


def _entry(value: tuple[str, dict[str, float]]) -> Column:
    return F.struct(F.lit(value[0]).alias("distribution"), F.create_map(*[F.lit(x) for pair in value[1].items() for x in pair]).alias("params"))


def default(role: Column, constraint: Column) -> Column:
    """struct(distribution, params) of a parameter that nothing is known of: by its role if that decides, else by its
    constraint."""
    out = None
    for column, table in ((role, BY_ROLE), (constraint, BY_CONSTRAINT)):
        for key, value in table.items():
            out = F.when(column == key, _entry(value)) if out is None else out.when(column == key, _entry(value))
    return out.otherwise(_entry(OTHERWISE))


def split_compound(compounds: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(key, compound, first, second): compound names taken apart at the first underscore that leaves a known name on either
    side. compounds: key, compound; first and second: key, name. Names without such a place are left out."""
    tokens = F.split("compound", "_")
    place = F.explode(F.sequence(F.lit(1), F.size(tokens) - 1))
    cut = compounds.where(F.size(tokens) > 1).select("key", "compound", tokens.alias("t"), place.alias("i"))
    cut = cut.select("key", "compound", "i", F.array_join(F.slice("t", 1, F.col("i")), "_").alias("first"), F.array_join(F.slice("t", F.col("i") + 1, F.size("t")), "_").alias("second"))
    known = cut.join(first.select("key", F.col("name").alias("first")).distinct(), ["key", "first"]).join(second.select("key", F.col("name").alias("second")).distinct(), ["key", "second"])
    best = known.groupBy("key", "compound").agg(F.min(F.struct("i", "first", "second")).alias("x"))
    return best.select("key", "compound", "x.first", "x.second")


def mixture(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS, least: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means and variances of a normal mixture in one dimension by expectation-maximisation from the quantiles, and
    its BIC."""
    mean, var, weight = np.quantile(x, (np.arange(k) + 0.5) / k), np.full(k, max(x.var() / k**2, least)), np.full(k, 1 / k)
    for _ in range(rounds + 1):
        log = np.log(weight) - 0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
        top = log.max(axis=1, keepdims=True)
        part = np.exp(log - top)
        total = part.sum(axis=1, keepdims=True)
        fit = float((np.log(total) + top).sum())
        part /= total
        n = part.sum(axis=0) + 1e-12
        weight, mean = n / n.sum(), part.T @ x / n
        var = np.maximum((part * (x[:, None] - mean) ** 2).sum(axis=0) / n, 0) + least
    return weight, mean, var, (3 * k - 1) * np.log(len(x)) - 2 * fit


POOLED = "mu double, sigma double, components int, weights array<double>, means array<double>, stds array<double>"


def pool_mixture(priors: DataFrame, by: str) -> DataFrame:
    """(by, POOLED) of several elicited normal priors (mu, sigma): a mixture of as many normals over their means as the BIC
    prefers, and its mean and spread with the elicited spreads added. One component, or under three priors, gives the plain
    mean and spread. A group is what was asked about one parameter and fits a task. Nulls are left out."""
    kind = priors.schema[by].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["mu", "sigma"])
        x, own = f["mu"].to_numpy(float), f["sigma"].to_numpy(float)
        fits = [mixture(x, k) for k in range(1, min(MOST_COMPONENTS, len(x) - 1) + 1)] if len(x) > 2 else []
        best = min(fits, key=lambda m: m[3]) if fits else None
        if best is None or len(best[0]) == 1:
            row = (x.mean(), np.sqrt((own**2).mean() + x.var()), 1, [1.0], [x.mean()], [x.std()])
        else:
            weight, mean, var, _ = best
            mu = float(weight @ mean)
            row = (mu, np.sqrt(weight @ (var + (mean - mu) ** 2) + (own**2).mean()), len(weight), weight.tolist(), mean.tolist(), np.sqrt(var).tolist())
        return pd.DataFrame([(f[by].iloc[0], *row)], columns=[by, *[c.split()[0] for c in POOLED.split(", ")]])

    return priors.where("mu is not null and sigma is not null").select(by, "mu", "sigma").groupBy(by).applyInPandas(run, f"`{by}` {kind}, {POOLED}")


def value_checks(draws: DataFrame, positive: list[str]) -> DataFrame:
    """(param, issue, share) of prior draws (param, value): not finite; negative where it should not be; extreme."""
    v, n = F.col("value"), F.count("*")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    out = draws.groupBy("param").agg((F.count_if(bad) / n).alias("bad"), (F.count_if(v < 0) / n).alias("low"), (F.count_if((F.abs(v) > EXTREME) & ~F.isnan(v)) / n).alias("far"))
    found = [
        ("not finite", F.col("bad"), F.col("bad") > 0), ("negative", F.col("low"), F.col("param").isin(positive) & (F.col("low") > NEGATIVE_SHARE)),
        ("extreme", F.col("far"), F.col("far") > EXTREME_SHARE)
    ]
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(name).alias("issue"), share.alias("share"))) for name, share, c in found]))
    return out.select("param", F.explode(rows).alias("x")).select("param", "x.*")


def implied(draws: DataFrame, names: list[str]) -> DataFrame:
    """(draw, stable, channel, std): the spread of each channel in the steady state of each draw. draws: draw, drift and
    diffusion (row by row), loading (channels by states, row by row) and noise (variance of each channel) as arrays. A draw
    without a steady state has one row, without channel."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for draw, a, g, load, noise in zip(f["draw"], f["drift"], f["diffusion"], f["loading"], f["noise"]):
                n = round(len(a) ** 0.5)
                a, g = np.asarray(a, float).reshape(n, n), np.asarray(g, float).reshape(n, n)
                load = np.asarray(load, float).reshape(-1, n)
                fine = np.isfinite(a).all() and np.linalg.eigvals(a).real.max() < 0
                own = load @ linear.lyapunov(a[None], (g @ g.T)[None])[0] @ load.T if fine else None
                if not fine or not np.isfinite(own).all() or (np.diag(own) < 0).any():
                    out.append((draw, False, None, None))
                    continue
                out += [(draw, True, c, s) for c, s in zip(names, np.sqrt(np.diag(own) + np.asarray(noise, float)))]
            yield pd.DataFrame(out, columns=["draw", "stable", "channel", "std"])

    return draws.select("draw", "drift", "diffusion", "loading", "noise").mapInPandas(run, "draw long, stable boolean, channel string, std double")


def scale_checks(implied_: DataFrame, data: DataFrame) -> DataFrame:
    """(param, issue, share): unstable dynamics (share of draws), and channels whose median implied spread is not within a
    factor SCALE_RATIO of the data's (share: the ratio). data: channel, std."""
    stable = implied_.select("draw", "stable").distinct().agg(F.avg((~F.col("stable")).cast("double")).alias("share")).where(F.col("share") > UNSTABLE_SHARE)
    ratio = implied_.where("stable").groupBy("channel").agg(F.median("std").alias("m")).join(data.where("std > 0"), "channel").select("channel", (F.col("m") / F.col("std")).alias("share"))
    odd = ratio.where((F.col("share") > SCALE_RATIO) | (F.col("share") < 1 / SCALE_RATIO))
    return stable.select(F.lit("dynamics").alias("param"), F.lit("unstable").alias("issue"), "share").unionByName(odd.select(
        F.concat(F.lit("scale_"), "channel").alias("param"), F.lit("scale").alias("issue"), "share"
    ))
