"""Queries of filters for channels of any family, states at their mode, samplers and prior draws."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from tideline.functions.families import Emissions
from tideline.lineage import cut
from tideline.operators import gibbs, inference, mixed, modes, prior_draws, statespace
from tideline.operators.mixed import Settings
from tideline.plans import states
from tideline.session import table

#: One latent variable seen through daily counts, and two that stand apart: of the mean and of the count.
COUNTED = {"a": [[-0.3]], "q": [[0.2]], "c": [0.1], "h": [[1]], "d": [0], "r": [[1]], "m0": [0], "p0": [[1]]}
APART = {"a": [[-0.3, 0], [0, -0.3]], "q": [[0.5, 0], [0, 0.2]], "c": [0.6, 0.1], "h": [[1, 0], [0, 1]], "d": [0, 0], "r": [[0.8, 0], [0, 1]], "m0": [2, 0], "p0": [[1.5, 0], [0, 1]]}
TIED = {"a": [[-0.5, 0.2], [0.1, -0.8]], "q": [[0.4, 0.1], [0.1, 0.3]], "c": [0.3, 0.1], "h": [[1, 0], [0.5, 1]], "d": [0, 0.1], "r": [[0.5, 0], [0, 0.7]], "m0": [1, 0], "p0": [[1, 0], [0, 1]]}


def counts(spark, sf_dir):
    """(user_id, t, y, n): daily means and numbers of events, in days since 2024-01-01."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("double")
    daily = table(spark, sf_dir, "events").groupBy("user_id", day.alias("t")).agg((F.avg("value") / states.SCALE).alias("y"), F.count("*").cast("double").alias("n"))
    return statespace.sort_panel(daily, "user_id", "t")


def _rounded(df, places=6):
    return df.select("user_id", "n", F.round("loglik", places).alias("loglik"))


def _rb(spark, d):
    return _rounded(mixed.rb_loglik(counts(spark, d), statespace.System.one(**COUNTED), Emissions(["poisson"]), "user_id", "t", ["n"]))


def _rb_normal(spark, d):
    """Of a normal channel, with predictors drawn: the Kalman filter, since nothing is left to draw."""
    return _rounded(mixed.rb_loglik(states._sorted(spark, d), states.one(), Emissions(["gaussian"]), "user_id", "t", ["y"], Settings(particles=4, exact=True)))


def _block(spark, d):
    """A normal block beside one that is drawn, with noise of Student's t, across shared noise and a shared channel."""
    how = Settings(particles=100, sampled=[1], df=[None, 5.0])
    return _rounded(mixed.rb_loglik(counts(spark, d), statespace.System.one(**TIED), Emissions(["gaussian", "poisson"]), "user_id", "t", ["y", "n"], how))


def _composed(spark, d):
    s, e = statespace.System.one(**APART), Emissions(["gaussian", "poisson"])
    split = mixed.blocks((s.a != 0)[0] | (s.q != 0)[0], s.h[0] != 0, e.families)
    return _rounded(mixed.composed_loglik(counts(spark, d), s, e, split, "user_id", "t", ["y", "n"]))


def _laplace(spark, d):
    return _rounded(modes.laplace_loglik(counts(spark, d), statespace.System.one(**COUNTED), Emissions(["poisson"]), "user_id", "t", ["n"]))


def _laplace_normal(spark, d):
    return _rounded(modes.laplace_loglik(states._sorted(spark, d), states.one(), Emissions(["gaussian"]), "user_id", "t", ["y"]))


def _bound(spark, d):
    return _rounded(modes.bound_loglik(counts(spark, d), statespace.System.one(**COUNTED), Emissions(["poisson"]), "user_id", "t", ["n"]))


def _modes(spark, d):
    rows = modes.smoothed(counts(spark, d), statespace.System.one(**COUNTED), Emissions(["poisson"]), "user_id", "t", ["n"])
    return rows.select("user_id", "t", F.round(F.col("mean")[0], 6).alias("mode"), F.round(F.col("cov")[0], 6).alias("var"))


def _count_target(spark, d):
    model = inference.structural(["A"], [], ["n"], {("n", "A"): 1.0}, families=["neg_binomial"])
    return inference.Target(cut(counts(spark, d)), model, "user_id", "t", ["n"])


def _both_target(spark, d):
    model = inference.structural(["level", "drive"], [], ["y", "n"], {("y", "level"): 1.0, ("n", "drive"): 1.0}, families=["gaussian", "poisson"])
    return inference.Target(cut(counts(spark, d)), model, "user_id", "t", ["y", "n"])


LATENTS, EFFECTS, CHANNELS, KINDS = ["A", "B"], [("A", "B")], ["x", "k", "z"], ["gaussian", "neg_binomial", "gamma"]
LOADS = {("x", "A"): 1.0, ("k", "B"): 1.0, ("z", "A"): None}


def prior_systems(spark, d):
    return prior_draws.systems(table(spark, d, "embeddings").select(F.col("vec_id").alias("draw")), LATENTS, EFFECTS, CHANNELS, LOADS, means=("x",), families=KINDS)


def _prior_draws(spark, d):
    named = {"drift": ["drift_A", None, "effect_B_A", "drift_B"], "diffusion": ["diffusion_A", None, None, "diffusion_B"], "cint": ["cint_A", "cint_B"], "loading": [None] * 4 + ["loading_z_A"], "mean": ["mean_x"],
             "noise": ["noise_x"], "start": ["start_A", "start_B"], "start_sd": ["start_sd_A", "start_sd_B"], "shapes": [None, "shape_k", "shape_z"]}
    return prior_draws.long_rows(prior_systems(spark, d), named).withColumn("value", F.round("value", 6))


def _prior_predictive(spark, d):
    return statespace.predictive(prior_systems(spark, d), [0.5 * k for k in range(8)], CHANNELS, KINDS)


QUERIES = {
    "rb_loglik": _rb,
    "rb_loglik_normal": _rb_normal,
    "block_loglik": _block,
    "composed_loglik": _composed,
    "laplace_loglik": _laplace,
    "laplace_loglik_normal": _laplace_normal,
    "bound_loglik": _bound,
    "mode_states": _modes,
    "fit_counts": lambda s, d: inference.laplace(_count_target(s, d), n=states.DRAWS),
    "fit_composed": lambda s, d: inference.laplace(_both_target(s, d), n=states.DRAWS),
    "fit_nuts": lambda s, d: inference.nuts(states._target(s, d), chains=12, steps=6, warm=6, depth=3),
    "fit_svi": lambda s, d: inference.svi(states._target(s, d), steps=60, parts=2, rate=0.15),
    "fit_hess_mc2": lambda s, d: inference.hess_mc2(states._target(s, d), particles=48, steps=6),
    "fit_pgas": lambda s, d: gibbs.pgas(states._target(s, d), chains=6, particles=20, rounds=9, moves=1, leaps=3),
    "prior_draws": _prior_draws,
    "prior_predictive": _prior_predictive,
}

_U = lambda name, at=0, slot=0: f"((CAST('0x' || md5(concat_ws('|', draw, '{name}', {at}, '{slot}'))[1:13] AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)"
_N = lambda name, at=0: f"(sqrt(-2 * ln({_U(name, at, 1)})) * cos({2 * pi!r} * {_U(name, at, 2)}))"


def _gamma_sql(name: str, shape: float, rate: float) -> str:
    d = shape - 1 / 3
    return f"""SELECT draw, '{name}' AS param, {d!r} * arg_min(v, i) / {rate} AS value FROM (
  SELECT draw, i, x, pow(1 + x / {(9 * d) ** 0.5!r}, 3) AS v, {_U(name, "i")} AS u FROM (SELECT draw, i, {_N(name, "i")} AS x FROM k, range(0, 64) AS r(i)))
  WHERE v > 0 AND ln(u) < 0.5 * x * x + {d!r} - {d!r} * v + {d!r} * ln(v) GROUP BY draw"""


_PLAIN = {
    "drift_A": f"-abs(-0.5 + {_N('drift_A')})", "drift_B": f"-abs(-0.5 + {_N('drift_B')})", "effect_B_A": f"0.5 * {_N('effect_B_A')}", "cint_A": _N("cint_A"), "cint_B": _N("cint_B"),
    "diffusion_A": f"abs({_N('diffusion_A')})", "diffusion_B": f"abs({_N('diffusion_B')})", "loading_z_A": f"0.5 + 0.5 * {_N('loading_z_A')}", "mean_x": f"2 * {_N('mean_x')}", "noise_x": f"abs({_N('noise_x')})",
    "start_A": f"2 * {_N('start_A')}", "start_B": f"2 * {_N('start_B')}", "start_sd_A": f"abs(2 * {_N('start_sd_A')})", "start_sd_B": f"abs(2 * {_N('start_sd_B')})",
}
ORACLES = {
    "rb_loglik_normal": states.ORACLES["kalman_1d"],
    "laplace_loglik_normal": states.ORACLES["kalman_1d"],
    "prior_draws": "WITH k AS (SELECT vec_id AS draw FROM embeddings WHERE vec_id IS NOT NULL), p AS ("
    + " UNION ALL ".join([f"SELECT draw, '{name}' AS param, {sql} AS value FROM k" for name, sql in _PLAIN.items()] + [_gamma_sql("shape_k", 2.0, 0.5), _gamma_sql("shape_z", 2.0, 1.0)])
    + ") SELECT draw, param, round(value, 6) AS value FROM p",
}
