"""Analytics over posterior draws: long tables (draw, param, value) or one row for each draw with the system's entries."""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, exp, gamma, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import linear
from tideline.functions.quantiles import quantiles

#: Thresholds of the checks: fixed values.
UNIFORM = 0.01
COVERAGE_LOW, COVERAGE_HIGH, AUTOCORRELATION, VARIANCE_RATIO, SENSITIVE, LOADING = 0.70, 0.98, 0.3, 3.0, 0.05, 0.01
ALPHA = 0.01


def summary(draws: DataFrame) -> DataFrame:
    """(param, mean, std, p5, p95); std over the draws themselves, percentiles interpolated."""
    v = F.col("value")
    return draws.groupBy("param").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).join(quantiles(draws, ["param"], "value", {"p5": 0.05, "p95": 0.95}), "param", "left")


def steady_2d(a11: Column, a12: Column, a21: Column, a22: Column, c1: Column, c2: Column) -> tuple[Column, Column]:
    """Steady state of a two-variable system; null if it is singular."""
    det = F.nullif(a11 * a22 - a12 * a21, F.lit(0.0))
    return (a12 * c2 - a22 * c1) / det, (a21 * c1 - a11 * c2) / det


def effects(draws: DataFrame, names: list[str], outcome: str) -> DataFrame:
    """(draw, treatment, effect) of holding each variable one above its steady state. draws: draw, drift (row by row) and
    cint as arrays; a draw with a singular system gives null."""
    n, target = len(names), names.index(outcome)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            a = np.stack(f["drift"].to_numpy()).reshape(-1, n, n).astype(float)
            c = np.stack(f["cint"].to_numpy()).astype(float)
            for j, name in enumerate(names):
                if j == target:
                    continue
                out = np.full(len(a), np.nan)
                fine = np.linalg.cond(a) < 1e12
                out[fine] = linear.effect(a[fine], c[fine], j, target)
                yield pd.DataFrame({"draw": f["draw"], "treatment": name, "effect": pd.array(out, "Float64")})

    return draws.select("draw", "drift", "cint").mapInPandas(run, "draw long, treatment string, effect double").withColumn("effect", F.nanvl("effect", F.lit(None).cast("double")))


def rank_effects(effects_: DataFrame) -> DataFrame:
    """(treatment, effect_size, low, high, prob_positive, place), the largest effect first; null counts as none."""
    e = F.col("effect")
    out = effects_.groupBy("treatment").agg(F.avg(e).alias("effect_size"), F.avg((e > 0).cast("double")).alias("prob_positive"))
    out = out.join(quantiles(effects_, ["treatment"], "effect", {"low": 0.025, "high": 0.975}), "treatment", "left").select("treatment", "effect_size", "low", "high", "prob_positive")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.abs(F.coalesce("effect_size", F.lit(0.0))).desc(), "treatment")))  # one row a treatment


def intervention_table(effects_: DataFrame, asked: DataFrame, known: list[str], verdicts: DataFrame) -> DataFrame:
    """(treatment, effect_size, low, high, prob_positive, identifiable, warning, place) of every treatment asked for. asked:
    treatment; known: names of the model's variables; verdicts: treatment, identifiable, blockers. A treatment that the
    model does not know, or without effects, has none; one without a verdict counts as identifiable."""
    own = asked.select("treatment").distinct().join(rank_effects(effects_).drop("place"), "treatment", "left")
    told = own.join(verdicts.select("treatment", "identifiable", "blockers"), "treatment", "left").withColumn("identifiable", F.coalesce("identifiable", F.lit(True)))
    unknown = ~F.col("treatment").isin(known)
    blocked = F.when(F.size("blockers") > 0, F.concat(F.lit("not identifiable (blocked by: "), F.array_join("blockers", ", "), F.lit(")"))).otherwise("not identifiable (missing proxies)")
    told = told.withColumn("warning", F.when(unknown, "not in the model").when(~F.col("identifiable"), blocked))
    order = Window.orderBy(F.abs(F.coalesce("effect_size", F.lit(0.0))).desc(), "treatment")  # one row a treatment
    return told.select("treatment", "effect_size", "low", "high", "prob_positive", "identifiable", "warning", F.row_number().over(order).alias("place"))


def relevant_channels(loadings: DataFrame, outcome: str) -> DataFrame:
    """(treatment, channel): channels that load on the treatment or on the outcome. loadings: draw, channel, latent, value,
    with rows for every channel and latent; means over draws count from LOADING on."""
    means = loadings.groupBy("channel", "latent").agg((F.abs(F.avg("value")) >= LOADING).alias("loads"))
    on_outcome = means.where((F.col("latent") == outcome) & F.col("loads")).select("channel", F.lit(True).alias("wanted"))
    own = means.where(F.col("latent") != outcome).join(on_outcome, "channel", "left")
    return own.where("loads or wanted").select(F.col("latent").alias("treatment"), "channel")


def attach_warnings(warnings: DataFrame, channels: DataFrame) -> DataFrame:
    """(treatment, channel, check) of the checks that failed on a channel relevant to a treatment. warnings: variable,
    check."""
    return channels.join(warnings.select(F.col("variable").alias("channel"), "check"), "channel").select("treatment", "channel", "check")


def thin(draws: DataFrame, keep: int) -> DataFrame:
    """The draws (draw: 0 to n - 1) at `keep` even places from the first to the last; all of fewer."""
    n = draws.agg(F.max("draw") + 1).scalar()
    if keep < 2:
        return draws.where(F.col("draw") < keep)
    place = F.ceil(F.col("draw") * F.lit(keep - 1) / (n - 1))
    return draws.where((n <= keep) | (F.floor(place * (n - 1) / F.lit(keep - 1)) == F.col("draw")))


def coverage(obs: DataFrame, sims: DataFrame) -> DataFrame:
    """(variable, n, share, warn): observations within the 95% band of the simulations. obs: variable, t, value; sims:
    also draw."""
    band = quantiles(sims, ["variable", "t"], "value", {"low": 0.025, "high": 0.975})
    inside = F.avg(F.col("value").between(F.col("low"), F.col("high")).cast("double"))
    out = obs.where("value is not null").join(band, ["variable", "t"]).groupBy("variable").agg(F.count("*").alias("n"), inside.alias("share")).where("n >= 2")
    return out.withColumn("warn", (F.col("share") < COVERAGE_LOW) | (F.col("share") > COVERAGE_HIGH))


def autocorrelation(obs: DataFrame, sims: DataFrame) -> DataFrame:
    """(variable, n, rho, warn): lag-one autocorrelation of what the simulations' mean leaves over."""
    centre = sims.groupBy("variable", "t").agg(F.avg("value").alias("mid"))
    left = obs.where("value is not null").join(centre, ["variable", "t"]).withColumn("e", F.col("value") - F.col("mid"))
    mean = left.groupBy("variable").agg(F.avg("e").alias("m"))
    left = left.join(mean, "variable").withColumn("e", F.col("e") - F.col("m"))
    left = left.withColumn("before", F.lag("e").over(Window.partitionBy("variable").orderBy("t")))
    out = left.groupBy("variable").agg(F.count("*").alias("n"), F.avg(F.col("e") * F.col("before")).alias("top"), F.var_pop("e").alias("var")).where("n >= 5 and var >= 1e-12")
    return out.select("variable", "n", (F.col("top") / F.col("var")).alias("rho")).withColumn("warn", F.abs("rho") > AUTOCORRELATION)


def variance_ratio(obs: DataFrame, sims: DataFrame) -> DataFrame:
    """(variable, n, ratio, warn): mean spread over time of the simulations to that of the observations."""
    seen = obs.where("value is not null").groupBy("variable").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("own")).where("n >= 3")
    made = sims.groupBy("variable", "draw").agg(F.stddev_pop("value").alias("s")).groupBy("variable").agg(F.avg("s").alias("sim"))
    out = seen.join(made, "variable").select("variable", "n", (F.col("sim") / F.nullif("own", F.lit(0.0))).alias("ratio"))
    return out.withColumn("warn", (F.col("ratio") > VARIANCE_RATIO) | (F.col("ratio") < 1 / VARIANCE_RATIO))


def power_shift(draws: DataFrame, weight: str, alpha: float = ALPHA) -> DataFrame:
    """(param, shift): how far the mean moves when the log-density in column `weight` is raised by alpha, over alpha."""
    top = draws.agg(F.max(weight)).scalar()
    w = F.exp(F.lit(alpha) * (F.col(weight) - top))
    moved = F.sum(w * F.col("value")) / F.sum(w)
    return draws.groupBy("param").agg((F.abs(moved - F.avg("value")) / F.lit(alpha)).alias("shift"))


def power_scaling(draws: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(param, prior, likelihood, verdict). draws: param, value, log_prior, log_lik."""
    prior = power_shift(draws, "log_prior", alpha).withColumnRenamed("shift", "prior")
    lik = power_shift(draws, "log_lik", alpha).withColumnRenamed("shift", "likelihood")
    p, k = F.col("prior") > SENSITIVE, F.col("likelihood") > SENSITIVE
    return prior.join(lik, "param").withColumn("verdict", F.when(p & ~k, "prior_dominated").when(p & k, "prior_data_conflict").otherwise("well_identified"))


def t_rule(rows: DataFrame) -> DataFrame:
    """rows (manifest, times, free) with moments and passes: p + p(p + 1) / 2 + (T - 1) p moments, as many as free
    parameters at least."""
    p, t = F.col("manifest"), F.col("times")
    moments = p + (p * (p + 1) / 2).cast("bigint") + (t - 1) * p
    return rows.withColumn("moments", moments.cast("bigint")).withColumn("passes", F.col("moments") >= F.col("free"))


def pool_priors(priors: DataFrame, by: str) -> DataFrame:
    """(by, mu, sigma) of several elicited normal priors (mu, sigma)."""
    return priors.groupBy(by).agg(F.avg("mu").alias("mu"), F.sqrt(F.avg(F.pow("sigma", 2)) + F.var_pop("mu")).alias("sigma"))


def recovery(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, rmse, r, covered) of estimates: truth, estimate, low, high."""
    spread = F.nullif(F.stddev_samp("truth") * F.stddev_samp("estimate"), F.lit(0.0))
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("estimate") - F.col("truth"), 2))).alias("rmse"),
        (F.covar_samp("truth", "estimate") / spread).alias("r"), F.avg(F.col("truth").between(F.col("low"), F.col("high")).cast("double")).alias("covered"),
    )


def sbc_ranks(rows: DataFrame, bins: int) -> DataFrame:
    """(bin, n) of the ranks of truths among their draws. rows: truth, draws (array)."""
    rank = F.size(F.filter("draws", lambda x: x < F.col("truth")))
    place = F.floor(rank * F.lit(bins) / (F.size("draws") + 1)).cast("int")
    return rows.select(place.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def sbc_uniformity(counts: DataFrame, bins: int) -> DataFrame:
    """(n, chi2, dof) of bin counts (bin, n) against equal ones; empty bins need no row."""
    total = F.sum("n")
    even = total / F.lit(bins)
    return counts.agg(total.alias("n"), (F.sum(F.pow("n", F.lit(2))) / even - total).alias("chi2"), F.lit(bins - 1).alias("dof"))


def chi_square_tail(x: float, dof: int) -> float:
    """Chance of a larger chi-square value: the finite sums for whole degrees of freedom."""
    half = x / 2
    if dof % 2 == 0:
        term = total = 1.0
        for k in range(1, dof // 2):
            term *= half / k
            total += term
        return exp(-half) * total
    term, total = sqrt(half) / gamma(1.5), 0.0
    for k in range(1, (dof - 1) // 2 + 1):
        total += term
        term *= half / (k + 0.5)
    return erfc(sqrt(half)) + exp(-half) * total


def ranks_are_uniform(rows: DataFrame, bins: int) -> tuple[float, bool]:
    """The chance of ranks at least as uneven, and whether it exceeds UNIFORM. rows: as of `sbc_ranks`."""
    found = sbc_uniformity(sbc_ranks(rows, bins), bins).first()
    p = chi_square_tail(found.chi2, found.dof)
    return p, p > UNIFORM


def pareto_shape(excess: np.ndarray) -> float:
    """Shape of a generalised Pareto tail of excesses, by the mean over profile weights and a weak prior to 0.5."""
    x = np.sort(excess)
    n = len(x)
    m = 30 + int(np.sqrt(n))
    theta = 1 / x[-1] + (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3 * x[int(n / 4 + 0.5) - 1])
    k = np.log1p(-theta[:, None] * x).mean(axis=1)
    fit = n * (np.log(-theta / k) - k - 1)
    weight = np.exp(fit - fit.max())
    weight /= weight.sum()
    shape = np.log1p(-(theta @ weight) * x).mean()
    return float((n * shape + 10 * 0.5) / (n + 10))


def pareto_k(draws: DataFrame, weight: str, alpha: float = ALPHA) -> float | None:
    """How heavy the tail of the weights exp(alpha * weight) of draws is (one row for each draw): below 0.7 their mean can be
    trusted. The driver gets the largest 3 sqrt(n) weights, a fifth of few; None for under five, and for equal ones."""
    n, top = draws.agg(F.count(weight), F.max(weight)).first()
    tail = int(min(0.2 * n, 3 * n**0.5))
    if tail < 5:
        return None
    rows = draws.where(F.col(weight).isNotNull()).orderBy(F.col(weight).desc()).limit(tail + 1).select(weight).toArrow()
    w = np.exp(alpha * (rows.column(weight).to_numpy() - top))
    excess = w[:tail] - w[tail]
    return pareto_shape(excess[excess > 0]) if (excess > 0).sum() >= 5 else None
