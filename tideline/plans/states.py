"""Queries of the state-space operators: one series for each user of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import emissions
from tideline.lineage import cut
from tideline.operators import inference, mixed, statespace
from tideline.session import table
from tideline.sources.adapters import DRAWS_SQL, EVENT_TYPES, draws

#: Drift, diffusion variance, intercept, measurement variance, and the initial mean and variance of the one-latent system.
A, Q, C, R, M0, P0 = -0.3, 0.5, 0.6, 0.8, 2.0, 1.5
SCALE = 100.0
DRAWS = 200


def panel(spark, sf_dir):
    """(user_id, t, y): daily means, in days since 2024-01-01."""
    ev = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("double")
    return ev.groupBy("user_id", day.alias("t")).agg((F.avg("value") / SCALE).alias("y"))


def one() -> statespace.System:
    return statespace.System.one(a=[[A]], q=[[Q]], c=[C], h=[[1]], d=[0], r=[[R]], m0=[M0], p0=[[P0]])


def two() -> statespace.System:
    return statespace.System.one(a=[[-0.5, 0.2], [0.1, -0.8]], q=[[0.4, 0.1], [0.1, 0.3]], c=[1.0, 0.5], h=[[1, 0], [0.5, 1]], d=[0, 0.1], r=[[0.5, 0], [0, 0.7]], m0=[2, 1], p0=[[1, 0], [0, 1]])


def two_channels(spark, sf_dir):
    """(user_id, t, looks, acts): daily means of events that only look and of those that do something; null where there is
    none."""
    ev = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("double")
    looks = F.col("event_type").isin("view", "click")
    mean = lambda which: F.avg(F.when(which, F.col("value"))) / SCALE
    return ev.groupBy("user_id", day.alias("t")).agg(mean(looks).alias("looks"), mean(~looks).alias("acts"))


def _sorted(spark, sf_dir):
    return statespace.sort_panel(panel(spark, sf_dir), "user_id", "t")


def _kalman(spark, d):
    return statespace.loglik(_sorted(spark, d), one(), "user_id", "t", ["y"]).select("user_id", "n", F.round("loglik", 6).alias("loglik"))


def _kalman_nd(spark, d):
    p = statespace.sort_panel(two_channels(spark, d), "user_id", "t")
    return statespace.loglik(p, two(), "user_id", "t", ["looks", "acts"]).select("user_id", "n", F.round("loglik", 6).alias("loglik"))


def _smooth(spark, d):
    p = statespace.smoothed(_sorted(spark, d), one(), "user_id", "t", ["y"])
    return p.select("user_id", "t", F.round(F.col("mean")[0], 6).alias("mean"), F.round(F.col("cov")[0], 6).alias("var"))


def _filter(spark, d):
    p = statespace.filtered(_sorted(spark, d), one(), "user_id", "t", ["y"])
    return p.select("user_id", "t", F.round(F.col("mean")[0], 6).alias("mean"), F.round(F.col("cov")[0], 6).alias("var"))


def _particles(spark, d):
    return mixed.particle_loglik(_sorted(spark, d), one(), ["gaussian"], "user_id", "t", ["y"], 200).drop("system")


def _discretize(spark, d):
    a, dt = F.col("a11"), F.lit(0.5)
    return draws(spark, d).select(
        "draw", F.round(F.exp(a * dt), 6).alias("step"), F.round((F.exp(2 * a * dt) - 1) / (2 * a), 6).alias("noise"),
        F.round(F.col("c1") * (F.exp(a * dt) - 1) / a, 6).alias("shift")
    )


def _target(spark, d):
    return inference.Target(cut(_sorted(spark, d)), inference.one_latent(M0, P0), "user_id", "t", ["y"])


def _fit(method, **how):
    return lambda spark, d: inference.fit(_target(spark, d), method, **how)


def _pair_target(spark, d):
    """Daily means of all five event types of a user: two latent variables, the first of which drives the second."""
    ev = table(spark, d, "events").groupBy(
        "user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01")).cast("double").alias("t")
    ).pivot("event_type", EVENT_TYPES).agg((F.avg("value") - 60) / SCALE)
    ys = [c for c in ev.columns if c not in ("user_id", "t")]
    loads = {(ys[0], "A"): 1.0, (ys[1], "A"): None, (ys[2], "B"): 1.0, (ys[3], "B"): None, (ys[4], "B"): None}
    model = inference.structural(["A", "B"], [("A", "B")], ys, loads)
    return inference.Target(cut(statespace.sort_panel(ev, "user_id", "t")), model, "user_id", "t", ys)


def _profiles(spark, d):
    return inference.identified(inference.profile(_target(spark, d), points=12))


def _replicates(spark, d):
    """Replicates of three channels of different families from the embeddings as draws of one latent variable."""
    e = lambda k: F.element_at("embedding", k).cast("double")
    own = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("draw"), F.array(-0.5 - F.abs(e(1))).alias("drift"), F.array(F.abs(e(2)) + 0.1).alias("diffusion"), F.array(F.lit(1.0), F.lit(0.5), e(3)).alias("loading"),
        F.array(e(4)).alias("cint"), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("mean"), F.array(*[F.lit(0.3)] * 3).alias("noise"), F.array(F.lit(0.0)).alias("start"), F.array(F.lit(1.0)).alias("start_sd"),
    )
    return statespace.predictive(own, [0.5 * k for k in range(12)], ["level", "tally", "flag"], ["gaussian", "poisson", "bernoulli"])


#: Observed value and predictor of each family, from two entries of a draw.
Y = {"gaussian": "x", "student_t": "x", "poisson": "k", "neg_binomial": "k", "gamma": "g", "bernoulli": "b", "beta": "u"}


def _emission(family):
    def query(spark, d):
        x = draws(spark, d).select(
            "draw", F.col("a12").alias("x"), F.pmod("draw", F.lit(7)).cast("double").alias("k"), (-F.col("a11")).alias("g"),
            F.pmod("draw", F.lit(2)).cast("double").alias("b"), (1 / (1 - F.col("a22"))).alias("u"), F.col("a21").alias("eta")
        )
        return x.select("draw", F.round(emissions.log_density(family, F.col(Y[family]), F.col("eta")), 6).alias("ll"))

    return query


QUERIES = {
    "discretize_1d": _discretize,
    "lyapunov_1d": lambda spark, d: draws(spark, d).select("draw", F.round(F.pow("c1", F.lit(2)) / (-2 * F.col("a11")), 6).alias("rest")),
    "kalman_1d": _kalman,
    "filter_states": _filter,
    "kalman_nd": _kalman_nd,
    "smooth_states": _smooth,
    "pf_loglik": _particles,
    "simulate_ssm": lambda spark, d: statespace.simulate(spark, two(), 50, 40, 0.5),
    **{f"emission_{f}": _emission(f) for f in emissions.FAMILIES},
    "fit_tempered_smc": _fit("tempered_smc"),
    "fit_laplace": _fit("laplace", n=DRAWS),
    "fit_hmc": _fit("hmc", chains=16, steps=18, leaps=4),
    "fit_two_latents": lambda spark, d: inference.fit(_pair_target(spark, d), "laplace", n=DRAWS),
    "profile_likelihood": _profiles,
    "ppc_simulate": _replicates,
}

_PI = "0.5 * ln(2 * pi())"
_LL = {
    "gaussian": f"-0.5 * pow(x - eta, 2) - {_PI}",
    "poisson": "k * eta - exp(eta) - lgamma(k + 1)",
    "student_t": "lgamma(3.0) - lgamma(2.5) - 0.5 * ln(5 * pi()) - 3 * ln(1 + pow(x - eta, 2) / 5)",
    "gamma": "-eta - g * exp(-eta)",
    "bernoulli": "CASE WHEN b = 1 THEN -ln(1 + exp(-eta)) ELSE -ln(1 + exp(eta)) END",
    "neg_binomial": "lgamma(k + 5) - lgamma(5.0) - lgamma(k + 1) + 5 * ln(5 / (5 + exp(eta))) + k * ln(exp(eta) / (5 + exp(eta)) + 1e-10)",
    "beta": "lgamma(10.0) - lgamma(10 / (1 + exp(-eta))) - lgamma(10 - 10 / (1 + exp(-eta))) + (10 / (1 + exp(-eta)) - 1) * ln(u) + (9 - 10 / (1 + exp(-eta))) * ln(1 - u)",
}
_X = f"{DRAWS_SQL}, x AS (SELECT draw, a12 AS x, (draw % 7)::DOUBLE AS k, -a11 AS g, (draw % 2)::DOUBLE AS b, 1 / (1 - a22) AS u, a21 AS eta FROM draws)"
_FILTER = f"""WITH RECURSIVE d AS (SELECT user_id, (CAST(ts AS DATE) - DATE '2024-01-01')::DOUBLE AS t, avg(value) / {SCALE} AS y FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM d),
f(user_id, k, t, m, p, ll) AS (
  SELECT user_id, k, t, {M0} + {P0} / ({P0} + {R}) * (y - {M0}), {P0}::DOUBLE - {P0} * {P0} / ({P0} + {R}), -0.5 * (ln(2 * pi()) + ln({P0} + {R}) + pow(y - {M0}, 2) / ({P0} + {R})) FROM o WHERE k = 1
  UNION ALL
  SELECT user_id, k, t, mb + pb / (pb + {R}) * (y - mb), pb - pb * pb / (pb + {R}), ll - 0.5 * (ln(2 * pi()) + ln(pb + {R}) + pow(y - mb, 2) / (pb + {R})) FROM (
    SELECT o.user_id, o.k, o.t, o.y, f.ll, exp({A} * dt) * f.m + {C} * (exp({A} * dt) - 1) / ({A}) AS mb, exp(2 * {A} * dt) * f.p + {Q} * (exp(2 * {A} * dt) - 1) / (2 * {A}) AS pb
    FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
)"""

ORACLES = {
    "discretize_1d": f"WITH {DRAWS_SQL} SELECT draw, round(exp(a11 * 0.5), 6) AS step, round((exp(a11) - 1) / (2 * a11), 6) AS noise, round(c1 * (exp(a11 * 0.5) - 1) / a11, 6) AS shift FROM draws",
    "lyapunov_1d": f"WITH {DRAWS_SQL} SELECT draw, round(c1 * c1 / (-2 * a11), 6) AS rest FROM draws",
    "kalman_1d": f"{_FILTER} SELECT user_id, max(k) AS n, round(arg_max(ll, k), 6) AS loglik FROM f GROUP BY 1",
    "filter_states": f"{_FILTER} SELECT user_id, t, round(m, 6) AS mean, round(p, 6) AS var FROM f",
    **{f"emission_{f}": f"WITH {_X} SELECT draw, round({sql}, 6) AS ll FROM x" for f, sql in _LL.items()},
}
