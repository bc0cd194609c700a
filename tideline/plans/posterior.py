"""Queries over posterior draws, for which the embeddings stand in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tideline.operators import posterior as po
from tideline.operators import priors as pr
from tideline.operators import reshape
from tideline.session import table
from tideline.sources.adapters import DRAWS_SQL, draws

ENTRIES = ["a11", "a12", "a21", "a22", "c1", "c2"]
BINS = 8


def _rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def _e(k):
    return F.element_at("embedding", k).cast("double")


def _long(spark, d):
    return reshape.unpivot_draws(draws(spark, d), ENTRIES)


def _steady(spark, d):
    s1, s2 = po.steady_2d(*[F.col(c) for c in ENTRIES])
    return draws(spark, d).select("draw", F.round(s1, 6).alias("s1"), F.round(s2, 6).alias("s2"))


def _effects(spark, d):
    rows = draws(spark, d).select("draw", F.array(*ENTRIES[:4]).alias("drift"), F.array(*ENTRIES[4:]).alias("cint"))
    return po.effects(rows, ["first", "second"], "first").unionByName(po.effects(rows, ["first", "second"], "second"))


def _sims(spark, d):
    """(obs, sims): a label is a variable; the first vector of each is observed, the others are simulated."""
    own = table(spark, d, "embeddings").select(
        F.col("label").alias("variable"), F.col("vec_id").alias("draw"), F.posexplode("embedding").alias("t", "value")
    ).withColumn("value", F.col("value").cast("double"))
    first = table(spark, d, "embeddings").groupBy(F.col("label").alias("variable")).agg(F.min("vec_id").alias("draw"))
    return own.join(first, ["variable", "draw"], "left_semi").drop("draw"), own.join(first, ["variable", "draw"], "left_anti")


def _power(spark, d):
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("draw"), (_e(7) * 10).alias("log_prior"), (_e(8) * 100).alias("log_lik"))
    return po.power_scaling(_long(spark, d).join(own, "draw"))


def _t_rule(spark, _):
    rows = spark.range(1, 7).select(F.col("id").alias("manifest"), F.explode(F.array(*[F.lit(t).cast("bigint") for t in (1, 2, 5)])).alias("times"), F.lit(20).cast("bigint").alias("free"))
    return po.t_rule(rows)


def _pool(spark, d):
    return _rounded(po.pool_priors(table(spark, d, "embeddings").select("label", _e(1).alias("mu"), F.abs(_e(2)).alias("sigma")), "label"), "mu", "sigma")


def _recovery(spark, d):
    rows = table(spark, d, "embeddings").select("label", _e(1).alias("truth"), _e(2).alias("estimate"), (_e(2) - F.abs(_e(3))).alias("low"), (_e(2) + F.abs(_e(3))).alias("high"))
    return _rounded(po.recovery(rows, "label"), "rmse", "r", "covered")


def _sbc(spark, d):
    return po.sbc_ranks(table(spark, d, "embeddings").select(_e(1).alias("truth"), F.transform(F.slice("embedding", 2, 63), lambda x: x.cast("double")).alias("draws")), BINS)


VERDICTS = [("first", True, []), ("second", False, ["U", "V"]), ("ghost", False, [])]


def _table(spark, d):
    asked = spark.createDataFrame([(t,) for t in ("first", "second", "ghost", "extra")], "treatment string")
    verdicts = spark.createDataFrame(VERDICTS, "treatment string, identifiable boolean, blockers array<string>")
    return po.intervention_table(_effects(spark, d), asked, ["first", "second", "extra"], verdicts)


def _loadings(spark, d):
    """Draws of the loadings of three channels on three latent variables, some of them small on average."""
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("draw"), F.posexplode(F.slice("embedding", 1, 9)).alias("k", "value"))
    return own.select(
        "draw", F.concat(F.lit("m"), (F.col("k") % 3).cast("string")).alias("channel"),
        F.concat(F.lit("l"), F.floor(F.col("k") / 3).cast("string")).alias("latent"), F.col("value").cast("double").alias("value")
    )


def _warned(spark, d):
    channels = po.relevant_channels(_loadings(spark, d), "l0")
    return po.attach_warnings(spark.createDataFrame([("m0", "coverage"), ("m2", "variance"), ("m9", "coverage")], "variable string, check string"), channels)


#: Kinds of prior in turn, with what they have of parameters.
PRIORS = ["Normal", "HalfNormal", "BETA", "Uniform", "TruncatedNormal", "Cauchy"]
ROLES, CONSTRAINTS = ["ar_coefficient", "residual_sd", "fixed_effect", "loading", "correlation"], ["positive", "unit_interval", "correlation", "none"]


def _priors(spark, d):
    n = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, PRIORS)), (n % 6 + 1).cast("int"))
    entries = [("mu", n % 7 - 3.0), ("sigma", n % 5 + 0.5), ("alpha", n % 3 + 1.0), ("beta", n % 4 + 1.0), ("lower", n % 9 - 9.0), ("upper", n % 8 + 1.0)]
    given = F.map_filter(F.create_map(*[x for k, v in entries for x in (F.lit(k), v.cast("double"))]), lambda k, _: (n % 11 > 0) | (k == "alpha"))
    out = table(spark, d, "part").select(n, pr.normalised(name, given).alias("x"))
    return _rounded(out.select("p_partkey", "x.*"), "sigma")


def _defaults(spark, d):
    n = F.col("p_partkey")
    role, constraint = F.element_at(F.array(*map(F.lit, ROLES)), (n % 5 + 1).cast("int")), F.element_at(F.array(*map(F.lit, CONSTRAINTS)), (n % 4 + 1).cast("int"))
    out = table(spark, d, "part").select(n, pr.default(role, constraint).alias("x"))
    return out.select("p_partkey", "x.distribution", *[F.col("x.params")[k].alias(k) for k in ("alpha", "lower", "mu", "sigma")])


def _compounds(spark, d):
    """Names of one to three tokens joined in pairs; the known ones are those whose number is not divisible by 5."""
    n = F.col("p_partkey")
    name = lambda x: F.concat(
        F.lit("a"), (x % 4).cast("string"), F.when(x % 3 > 0, F.concat(F.lit("_b"), (x % 2).cast("string"))).otherwise(""),
        F.when(x % 3 > 1, F.lit("_c")).otherwise("")
    )
    own = table(spark, d, "part").select((n % 10).alias("key"), n)
    known = own.where(n % 5 > 0).select("key", name(n).alias("name"))
    made = own.select("key", F.concat(name(n), F.lit("_"), name(n + 10)).alias("compound")).distinct()
    return pr.split_compound(made, known, known)


def _mixed_priors(spark, d):
    rows = table(spark, d, "embeddings").select("label", (_e(1) + F.when(F.col("vec_id") % 3 == 0, 2.0).otherwise(0.0)).alias("mu"), F.abs(_e(2)).alias("sigma"))
    return _rounded(pr.pool_mixture(rows, "label"), "mu", "sigma").select("label", "mu", "sigma", "components")


def _prior_values(spark, d):
    v = _e(1)
    cases = {"wide": v * 1e8, "sd": v, "fine": F.abs(v), "broken": F.when(F.col("vec_id") % 50 == 0, F.lit(float("nan"))).otherwise(v)}
    own = table(spark, d, "embeddings")
    parts = [own.select(F.lit(k).alias("param"), c.alias("value")) for k, c in cases.items()]
    return _rounded(pr.value_checks(reduce(lambda a, b: a.unionByName(b), parts), ["sd"]), "share")


def _prior_scales(spark, d):
    """One state, two channels: its spread is q / sqrt(2 a) where a is positive."""
    own = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("draw"), F.array(-_e(1) - 0.05).alias("drift"), F.array(F.abs(_e(2)) + 0.1).alias("diffusion"),
        F.array(F.lit(1.0), F.lit(300.0)).alias("loading"), F.array(F.lit(0.01), F.lit(0.0)).alias("noise")
    )
    data = spark.createDataFrame([("small", 0.5), ("large", 0.5), ("still", 0.0)], "channel string, std double")
    return _rounded(pr.scale_checks(pr.implied(own, ["small", "large"]), data), "share")


QUERIES = {
    "intervention_table": lambda s, d: _rounded(_table(s, d), "effect_size", "low", "high", "prob_positive"),
    "relevant_channels": lambda s, d: po.relevant_channels(_loadings(s, d), "l0"),
    "ppc_warnings": _warned,
    "thin_draws": lambda s, d: po.thin(table(s, d, "embeddings").select(F.col("vec_id").alias("draw")), 37),
    "sbc_uniformity": lambda s, d: _rounded(po.sbc_uniformity(_sbc(s, d), BINS), "chi2"),
    "prior_normalise": _priors,
    "prior_default": _defaults,
    "compound_split": _compounds,
    "prior_pool_mixture": _mixed_priors,
    "prior_value_checks": _prior_values,
    "prior_scale_checks": _prior_scales,
    "posterior_summary": lambda s, d: _rounded(po.summary(_long(s, d)), "mean", "std", "p5", "p95"),
    "steady_state_2d": _steady,
    "do_effect": lambda s, d: _rounded(_effects(s, d), "effect"),
    "intervention_rank": lambda s, d: _rounded(po.rank_effects(_effects(s, d)), "effect_size", "low", "high", "prob_positive"),
    "ppc_coverage": lambda s, d: _rounded(po.coverage(*_sims(s, d)), "share"),
    "ppc_autocorr": lambda s, d: _rounded(po.autocorrelation(*_sims(s, d)), "rho"),
    "ppc_variance_ratio": lambda s, d: _rounded(po.variance_ratio(*_sims(s, d)), "ratio"),
    "power_scaling": lambda s, d: _rounded(_power(s, d), "prior", "likelihood", places=5),
    "t_rule": _t_rule,
    "prior_pool": _pool,
    "recovery_metrics": _recovery,
    "sbc_ranks": _sbc,
}

_UNPIVOT = "long AS (" + " UNION ALL ".join(f"SELECT draw, '{c}' AS param, {c} AS value FROM draws" for c in ENTRIES) + ")"
_EFFECT = "eff AS (SELECT draw, 'second' AS treatment, -a12 / a11 AS effect FROM draws UNION ALL SELECT draw, 'first', -a21 / a22 FROM draws)"
_SIMS = """own AS (SELECT label AS variable, vec_id AS draw, CAST(i - 1 AS INTEGER) AS t, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, len(embedding) + 1) AS r(i)),
first AS (SELECT label AS variable, min(vec_id) AS draw FROM embeddings GROUP BY 1), obs AS (SELECT own.* FROM own JOIN first USING (variable, draw)), sims AS (SELECT own.* FROM own ANTI JOIN first USING (variable, draw))"""
_SHIFT = lambda c: f"abs(sum(exp(0.01 * ({c} - (SELECT max({c}) FROM lp))) * value) / sum(exp(0.01 * ({c} - (SELECT max({c}) FROM lp)))) - avg(value)) / 0.01"

_LOADED = """l AS (SELECT vec_id AS draw, 'm' || CAST((i - 1) % 3 AS VARCHAR) AS channel, 'l' || CAST((i - 1) // 3 AS VARCHAR) AS latent, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 10) AS r(i)),
big AS (SELECT channel, latent FROM l GROUP BY 1, 2 HAVING abs(avg(value)) >= 0.01), rel AS (SELECT latent AS treatment, channel FROM big WHERE latent <> 'l0' UNION SELECT t.latent, b.channel FROM (SELECT DISTINCT latent FROM l WHERE latent <> 'l0') t, big b WHERE b.latent = 'l0')"""
_PRIOR = lambda c, v, default: f"coalesce(CASE WHEN p_partkey % 11 > 0 OR '{c}' = 'alpha' THEN ({v})::DOUBLE END, {default}::DOUBLE)"
_NAME = lambda x: f"'a' || ({x} % 4)::VARCHAR || CASE WHEN {x} % 3 > 0 THEN '_b' || ({x} % 2)::VARCHAR ELSE '' END || CASE WHEN {x} % 3 > 1 THEN '_c' ELSE '' END"

ORACLES = {
    "intervention_table": f"""WITH {DRAWS_SQL}, {_EFFECT}, g AS (SELECT treatment, avg(effect) AS e, quantile_cont(effect, 0.025) AS l, quantile_cont(effect, 0.975) AS h, avg((effect > 0)::INT::DOUBLE) AS p FROM eff GROUP BY 1),
a(treatment, identifiable, warning) AS (VALUES ('first', true, NULL), ('second', false, 'not identifiable (blocked by: U, V)'), ('ghost', false, 'not in the model'), ('extra', true, NULL))
SELECT treatment, round(e, 6) AS effect_size, round(l, 6) AS low, round(h, 6) AS high, round(p, 6) AS prob_positive, identifiable, warning, CAST(row_number() OVER (ORDER BY abs(coalesce(e, 0)) DESC, treatment) AS INTEGER) AS place FROM a LEFT JOIN g USING (treatment)""",
    "relevant_channels": f"WITH {_LOADED} SELECT treatment, channel FROM rel",
    "ppc_warnings": f"WITH {_LOADED} SELECT treatment, channel, w.check FROM rel JOIN (VALUES ('m0', 'coverage'), ('m2', 'variance')) w(channel, \"check\") USING (channel)",
    "thin_draws": "SELECT DISTINCT vec_id AS draw FROM embeddings, range(0, 37) AS r(j), (SELECT max(vec_id) + 1 AS n FROM embeddings) WHERE vec_id = CAST(floor(j * (n - 1) / 36) AS BIGINT)",
    "sbc_uniformity": f"WITH c AS (SELECT floor(len([x FOR x IN embedding[2:64] IF x < embedding[1]]) * {BINS} / 64.0) AS bin, count(*) AS n FROM embeddings GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * n) / (sum(n) / {BINS}) - sum(n), 6) AS chi2, {BINS - 1} AS dof FROM c",
    "prior_normalise": f"""WITH p AS (SELECT p_partkey, lower(CASE p_partkey % 6 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(PRIORS))} END) AS kind, {_PRIOR('mu', 'p_partkey % 7 - 3', 0)} AS mu, {_PRIOR('sigma', 'p_partkey % 5 + 0.5', 1)} AS sigma,
    {_PRIOR('alpha', 'p_partkey % 3 + 1', 2)} AS a, {_PRIOR('beta', 'p_partkey % 4 + 1', 2)} AS b, {_PRIOR('lower', 'p_partkey % 9 - 9', -1)} AS lo, {_PRIOR('upper', 'p_partkey % 8 + 1', 1)} AS hi FROM part)
SELECT p_partkey, CASE kind WHEN 'halfnormal' THEN NULL WHEN 'beta' THEN a / (a + b) WHEN 'uniform' THEN (lo + hi) / 2 ELSE mu END AS mu, round(CASE kind WHEN 'beta' THEN sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) WHEN 'uniform' THEN (hi - lo) / 4 ELSE sigma END, 6) AS sigma,
  CASE kind WHEN 'uniform' THEN lo END AS lower, CASE kind WHEN 'uniform' THEN hi END AS upper FROM p""",
    "prior_default": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Beta' WHEN p_partkey % 5 = 1 THEN 'HalfNormal' WHEN p_partkey % 4 = 0 THEN 'HalfNormal' WHEN p_partkey % 4 = 1 THEN 'Beta' WHEN p_partkey % 4 = 2 THEN 'Uniform' ELSE 'Normal' END AS distribution FROM part)
SELECT p_partkey, distribution, CASE distribution WHEN 'Beta' THEN 2.0::DOUBLE END AS alpha, CASE distribution WHEN 'Uniform' THEN -1.0::DOUBLE END AS lower, CASE distribution WHEN 'Normal' THEN 0.0::DOUBLE END AS mu, CASE distribution WHEN 'HalfNormal' THEN 1.0::DOUBLE WHEN 'Normal' THEN 0.5::DOUBLE END AS sigma FROM p""",
    "compound_split": f"""WITH k AS (SELECT DISTINCT p_partkey % 10 AS key, {_NAME('p_partkey')} AS name FROM part WHERE p_partkey % 5 > 0), c AS (SELECT DISTINCT p_partkey % 10 AS key, {_NAME('p_partkey')} || '_' || {_NAME('(p_partkey + 10)')} AS compound FROM part),
m AS (SELECT c.key, compound, a.name AS first, b.name AS second, row_number() OVER (PARTITION BY c.key, compound ORDER BY length(a.name)) AS r FROM c JOIN k a ON a.key = c.key JOIN k b ON b.key = c.key AND compound = a.name || '_' || b.name)
SELECT key, compound, first, second FROM m WHERE r = 1""",
    "prior_value_checks": """WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS v, count(*) OVER () AS n FROM embeddings), s AS (
  SELECT 'broken' AS param, 'not finite' AS issue, count(*) FILTER (WHERE vec_id % 50 = 0) / any_value(n) AS share, 0.0 AS least FROM e
  UNION ALL SELECT 'sd', 'negative', count(*) FILTER (WHERE v < 0) / any_value(n), 0.05 FROM e UNION ALL SELECT 'wide', 'extreme', count(*) FILTER (WHERE abs(v * 1e8) > 1e6) / any_value(n), 0.10 FROM e)
SELECT param, issue, round(share, 6) AS share FROM s WHERE share > least""",
    "prior_scale_checks": """WITH e AS (SELECT -CAST(embedding[1] AS DOUBLE) - 0.05 AS a, pow(abs(CAST(embedding[2] AS DOUBLE)) + 0.1, 2) AS q FROM embeddings),
r AS (SELECT median(sqrt(-q / (2 * a) + 0.01)) / 0.5 AS small, median(sqrt(90000 * -q / (2 * a))) / 0.5 AS large FROM e WHERE a < 0), u AS (SELECT avg((a >= 0)::INT::DOUBLE) AS share FROM e)
SELECT 'dynamics' AS param, 'unstable' AS issue, round(share, 6) AS share FROM u WHERE share > 0.5 UNION ALL SELECT 'scale_small', 'scale', round(small, 6) FROM r WHERE small > 100 OR small < 0.01 UNION ALL SELECT 'scale_large', 'scale', round(large, 6) FROM r WHERE large > 100 OR large < 0.01""",
    "posterior_summary": f"WITH {DRAWS_SQL}, {_UNPIVOT} SELECT param, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95 FROM long GROUP BY 1",
    "steady_state_2d": f"WITH {DRAWS_SQL} SELECT draw, round((a12 * c2 - a22 * c1) / (a11 * a22 - a12 * a21), 6) AS s1, round((a21 * c1 - a11 * c2) / (a11 * a22 - a12 * a21), 6) AS s2 FROM draws",
    "do_effect": f"WITH {DRAWS_SQL}, {_EFFECT} SELECT draw, treatment, round(effect, 6) AS effect FROM eff",
    "intervention_rank": f"""WITH {DRAWS_SQL}, {_EFFECT}, g AS (SELECT treatment, avg(effect) AS e, quantile_cont(effect, 0.025) AS l, quantile_cont(effect, 0.975) AS h, avg((effect > 0)::INT::DOUBLE) AS p FROM eff GROUP BY 1)
SELECT treatment, round(e, 6) AS effect_size, round(l, 6) AS low, round(h, 6) AS high, round(p, 6) AS prob_positive, CAST(row_number() OVER (ORDER BY abs(e) DESC, treatment) AS INTEGER) AS place FROM g""",
    "ppc_coverage": f"""WITH {_SIMS}, band AS (SELECT variable, t, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM sims GROUP BY 1, 2),
g AS (SELECT variable, count(*) AS n, avg((value BETWEEN low AND high)::INT::DOUBLE) AS share FROM obs JOIN band USING (variable, t) GROUP BY 1) SELECT variable, n, round(share, 6) AS share, share < 0.70 OR share > 0.98 AS warn FROM g""",
    "ppc_autocorr": f"""WITH {_SIMS}, mid AS (SELECT variable, t, avg(value) AS mid FROM sims GROUP BY 1, 2), e AS (SELECT variable, t, value - mid AS e FROM obs JOIN mid USING (variable, t)),
c AS (SELECT variable, t, e - avg(e) OVER (PARTITION BY variable) AS e FROM e), l AS (SELECT *, lag(e) OVER (PARTITION BY variable ORDER BY t) AS b FROM c),
g AS (SELECT variable, count(*) AS n, avg(e * b) / var_pop(e) AS rho FROM l GROUP BY 1) SELECT variable, n, round(rho, 6) AS rho, abs(rho) > 0.3 AS warn FROM g""",
    "ppc_variance_ratio": f"""WITH {_SIMS}, o AS (SELECT variable, count(*) AS n, stddev_pop(value) AS own FROM obs GROUP BY 1), s AS (SELECT variable, avg(s) AS sim FROM (SELECT variable, draw, stddev_pop(value) AS s FROM sims GROUP BY 1, 2) GROUP BY 1)
SELECT variable, n, round(sim / own, 6) AS ratio, sim / own > 3 OR sim / own < 1 / 3.0 AS warn FROM o JOIN s USING (variable)""",
    "power_scaling": f"""WITH {DRAWS_SQL}, {_UNPIVOT}, lp AS (SELECT vec_id AS draw, CAST(embedding[7] AS DOUBLE) * 10 AS log_prior, CAST(embedding[8] AS DOUBLE) * 100 AS log_lik FROM embeddings),
g AS (SELECT param, {_SHIFT('log_prior')} AS p, {_SHIFT('log_lik')} AS k FROM long JOIN lp USING (draw) GROUP BY 1)
SELECT param, round(p, 5) AS prior, round(k, 5) AS likelihood, CASE WHEN p > 0.05 AND NOT k > 0.05 THEN 'prior_dominated' WHEN p > 0.05 AND k > 0.05 THEN 'prior_data_conflict' ELSE 'well_identified' END AS verdict FROM g""",
    "t_rule": "SELECT p AS manifest, t AS times, CAST(20 AS BIGINT) AS free, CAST(p + p * (p + 1) // 2 + (t - 1) * p AS BIGINT) AS moments, p + p * (p + 1) // 2 + (t - 1) * p >= 20 AS passes FROM range(1, 7) AS a(p), (SELECT unnest([1, 2, 5])::BIGINT AS t)",
    "prior_pool": "SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS mu, round(sqrt(avg(pow(CAST(embedding[2] AS DOUBLE), 2)) + var_pop(CAST(embedding[1] AS DOUBLE))), 6) AS sigma FROM embeddings GROUP BY 1",
    "recovery_metrics": """WITH r AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS t, CAST(embedding[2] AS DOUBLE) AS e, abs(CAST(embedding[3] AS DOUBLE)) AS w FROM embeddings)
SELECT label, count(*) AS n, round(sqrt(avg(pow(e - t, 2))), 6) AS rmse, round(covar_samp(t, e) / (stddev_samp(t) * stddev_samp(e)), 6) AS r, round(avg((t BETWEEN e - w AND e + w)::INT::DOUBLE), 6) AS covered FROM r GROUP BY 1""",
    "sbc_ranks": f"SELECT CAST(floor(len([x FOR x IN embedding[2:64] IF x < embedding[1]]) * {BINS} / 64.0) AS INTEGER) AS bin, count(*) AS n FROM embeddings GROUP BY 1",
}
