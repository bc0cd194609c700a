"""Checks and scores of model specifications, many side by side: what is wrong with each, as rows.

Specifications are tables under a key: constructs (key, name, role, temporal_status, granularity, is_outcome), edges (key,
cause, effect, lagged), indicators (key, name, construct, granularity, dtype, aggregation, how_to_measure), likelihoods
(key, variable, distribution, link) and parameters (key, name, role, constraint). Every check is a join to a fixed table or
to another part of the same specification; issues are (key, part, name, issue, severity) and none means valid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.aggregates import REGISTRY
from tideline.operators import graph
from tideline.operators.observations import HOURS

ISSUE = ["key", "part", "name", "issue", "severity"]

# What goes with what.
DTYPES = ["binary", "categorical", "continuous", "count", "ordinal"]
DISTRIBUTIONS_OF_DTYPE = {
    "binary": ["bernoulli"],
    "count": ["poisson", "negative_binomial"],
    "continuous": ["gaussian", "student_t", "gamma", "beta"],
    "ordinal": ["ordered_logistic"],
    "categorical": ["categorical", "ordered_logistic"],
}
LINKS_OF_DISTRIBUTION = {
    "bernoulli": ["logit", "probit"],
    "poisson": ["log"],
    "negative_binomial": ["log"],
    "gaussian": ["identity"],
    "student_t": ["identity"],
    "gamma": ["log"],
    "beta": ["logit"],
    "ordered_logistic": ["cumulative_logit"],
    "categorical": ["softmax"],
}
LINKS = ["identity", "log", "logit", "probit", "cumulative_logit", "softmax"]
CONSTRAINT_OF_ROLE = {"ar_coefficient": "unit_interval", "residual_sd": "positive", "fixed_effect": "none", "loading": "positive", "correlation": "correlation"}
CONSTRAINTS = ["none", "positive", "unit_interval", "correlation"]
#: Points: a valid extraction, the least length of a telling description, and what identifiability is worth.
EXTRACTION_POINTS, LONG_TEXT = 10, 50
ALL_FROM_START, ALL_AFTER_PROXIES, SOME_AFTER_PROXIES = 10, 15, 5
#: Points of a functional specification: a fitting distribution, its link, an own lag, a constraint; all indicators covered, all
#: edges covered. Words of a parameter's name that name no construct.
FITTING, LINKED, LAGGED, CONSTRAINED, ALL_INDICATORS, ALL_EDGES = 2, 1, 3, 1, 5, 3
NOT_NAMES = ["ar", "beta", "sigma", "rho", "sd", "loading"]


def _pairs(spark: SparkSession, table: dict[str, list[str]], names: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k, v) for k, own in table.items() for v in own], names))


def _issue(df: DataFrame, part: str, name: Column | str, found: list[tuple[Column, str]], severity: str = "error") -> DataFrame:
    """A row for each condition that holds."""
    issues = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(text)) for c, text in found]))
    return df.select("key", F.lit(part).alias("part"), F.col(name).alias("name") if isinstance(name, str) else name.alias("name"), F.explode(issues).alias("issue"), F.lit(severity).alias("severity"))


def _repeated(df: DataFrame, part: str, name: str, severity: str = "error") -> DataFrame:
    """An issue for every repeat of a name."""
    more = df.where(F.col(name).isNotNull()).groupBy("key", name).agg((F.count("*") - 1).cast("int").alias("n")).where("n > 0")
    return more.select("key", F.lit(part).alias("part"), F.col(name).alias("name"), F.explode(F.array_repeat(F.lit("duplicate name"), F.col("n"))).alias("issue"), F.lit(severity).alias("severity"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _construct_faults() -> list[tuple[Column, str]]:
    varying, grain = F.col("temporal_status") == "time_varying", F.col("granularity")
    return [
        (~F.col("role").isin("endogenous", "exogenous") | F.col("role").isNull(), "unknown role"),
        (~F.col("temporal_status").isin("time_varying", "time_invariant") | F.col("temporal_status").isNull(), "unknown temporal status"),
        (varying & grain.isNull(), "granularity missing"),
        (varying & ~grain.isin(*HOURS), "unknown granularity"),
        (~varying & grain.isNotNull(), "granularity not allowed"),
        (F.col("is_outcome") & (F.col("role") != "endogenous"), "outcome not endogenous"),
    ]


def construct_issues(constructs: DataFrame) -> DataFrame:
    """Of single constructs, and repeated names."""
    return _issue(constructs, "construct", "name", _construct_faults()).unionByName(_repeated(constructs, "construct", "name"))


def sound_constructs(constructs: DataFrame) -> DataFrame:
    """Constructs without a fault of their own; of a repeated name the first by its fields."""
    faulty = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c, _ in _construct_faults()])
    rest = [c for c in constructs.columns if c not in ("key", "name")]
    return constructs.where(~faulty).groupBy("key", "name").agg(F.min(F.struct(*rest)).alias("x")).select("key", "name", "x.*")


def _edge_faults(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with `fault`, the first thing wrong with each."""
    own = sound_constructs(constructs)
    c = own.select("key", F.col("name").alias("cause"), F.lit(True).alias("c_known"), F.col("granularity").alias("c_grain"))
    e = own.select("key", F.col("name").alias("effect"), F.lit(True).alias("e_known"), F.col("granularity").alias("e_grain"), F.col("role").alias("e_role"))
    fault = (
        F.when(F.col("c_known").isNull(), "unknown cause")
        .when(F.col("e_known").isNull(), "unknown effect")
        .when(F.col("e_role") == "exogenous", "exogenous effect")
        .when(~F.col("lagged") & F.col("c_grain").isNotNull() & F.col("e_grain").isNotNull() & (F.col("c_grain") != F.col("e_grain")), "grains differ")
    )
    return edges.join(c, ["key", "cause"], "left").join(e, ["key", "effect"], "left").withColumn("fault", fault)


def latent_issues(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """Of constructs, edges and the whole: one outcome, a cause for it, no cycle within a time step. Edges with a fault
    count for neither of the last two."""
    judged = _edge_faults(constructs, edges)
    of_edges = _issue(judged, "edge", F.concat_ws(" -> ", "cause", "effect"), [(F.col("fault") == text, text) for text in ("unknown cause", "unknown effect", "exogenous effect", "grains differ")])
    good, own = judged.where("fault is null"), sound_constructs(constructs)
    outcomes = constructs.select("key").distinct().join(own.where("is_outcome").groupBy("key").agg(F.count("*").alias("n"), F.max("name").alias("outcome")), "key", "left")
    of_model = _issue(outcomes, "model", F.coalesce(F.when(F.col("n") == 1, F.col("outcome")), F.lit("")), [(F.col("n").isNull(), "no outcome"), (F.col("n") > 1, "several outcomes")])
    caused = good.select("key", F.col("effect").alias("outcome")).distinct()
    without = outcomes.where("n = 1").join(caused, ["key", "outcome"], "left_anti")
    uncaused = _issue(without, "model", "outcome", [(F.lit(True), "outcome without cause")])
    now = good.where("not lagged").select("key", "cause", "effect")
    around = graph.closure(now.select("key", F.col("cause").alias("start")).distinct(), now).where("start = node")
    cyclic = _issue(around.groupBy("key").agg(F.min("start").alias("name")), "model", "name", [(F.lit(True), "contemporaneous cycle")])
    return _all([construct_issues(constructs), of_edges, of_model, uncaused, cyclic])


def _indicator_faults() -> list[tuple[Column, str]]:
    return [
        (~F.col("dtype").isin(DTYPES) | F.col("dtype").isNull(), "unknown dtype"),
        (~F.col("aggregation").isin(*REGISTRY) | F.col("aggregation").isNull(), "unknown aggregation"),
        (~F.col("granularity").isin("finest", *HOURS) | F.col("granularity").isNull(), "unknown granularity"),
    ]


def _hours(grain: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in HOURS.items() for x in pair])[grain]


def measurement_issues(indicators: DataFrame, constructs: DataFrame) -> DataFrame:
    """Of single indicators, repeated names, unknown constructs, and indicators measured more coarsely than their construct
    moves. Only an indicator without a fault of its own is held against its construct."""
    faulty = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c, _ in _indicator_faults()])
    own = sound_constructs(constructs).select("key", F.col("name").alias("construct"), F.lit(True).alias("known"), "temporal_status", F.col("granularity").alias("causal"))
    held = indicators.where(~faulty).join(own, ["key", "construct"], "left")
    coarse = (F.col("temporal_status") == "time_varying") & (_hours(F.col("granularity")) > _hours(F.col("causal")))
    against = _issue(held, "indicator", "name", [(F.col("known").isNull(), "unknown construct"), (coarse, "coarser than its construct")])
    return _all([_issue(indicators, "indicator", "name", _indicator_faults()), _repeated(indicators, "indicator", "name"), against])


def causal_issues(constructs: DataFrame, edges: DataFrame, indicators: DataFrame) -> DataFrame:
    """A whole causal specification: constructs with edges, and what measures them."""
    return latent_issues(constructs, edges).unionByName(measurement_issues(indicators, constructs))


def model_issues(likelihoods: DataFrame, parameters: DataFrame, indicators: DataFrame | None = None) -> DataFrame:
    """Of likelihoods and parameters: unknown values, repeated names, a link that the distribution does not go with, a
    constraint that the role does not. With indicators also those without a likelihood, and distributions that do not go
    with the dtype. Severities: warning for a missing likelihood and for an unexpected constraint, else error."""
    spark = likelihoods.sparkSession
    known = [(~F.col("distribution").isin(*LINKS_OF_DISTRIBUTION), "unknown distribution"), (~F.col("link").isin(LINKS), "unknown link")]
    links = _pairs(spark, LINKS_OF_DISTRIBUTION, "distribution string, link string").withColumn("fits", F.lit(True))
    linked = likelihoods.where(F.col("distribution").isin(*LINKS_OF_DISTRIBUTION) & F.col("link").isin(LINKS)).join(links, ["distribution", "link"], "left")
    roles = _pairs(spark, {k: [v] for k, v in CONSTRAINT_OF_ROLE.items()}, "role string, expected string")
    bound = parameters.where(F.col("constraint").isin(CONSTRAINTS)).join(roles, "role")
    parts = [
        _repeated(likelihoods, "likelihood", "variable"),
        _repeated(parameters, "parameter", "name"),
        _issue(likelihoods, "likelihood", "variable", known),
        _issue(linked, "likelihood", "variable", [(F.col("fits").isNull(), "link does not fit the distribution")]),
        _issue(parameters, "parameter", "name", [(~F.col("role").isin(*CONSTRAINT_OF_ROLE), "unknown role"), (~F.col("constraint").isin(CONSTRAINTS), "unknown constraint")]),
        _issue(bound, "parameter", "name", [(F.col("constraint") != F.col("expected"), "unexpected constraint")], "warning"),
    ]
    if indicators is not None:
        dtypes = _pairs(spark, DISTRIBUTIONS_OF_DTYPE, "dtype string, distribution string").withColumn("fits", F.lit(True))
        own = indicators.groupBy("key", F.col("name").alias("variable")).agg(F.max(F.coalesce("dtype", F.lit("continuous"))).alias("dtype"))
        typed = likelihoods.where(F.col("distribution").isin(*LINKS_OF_DISTRIBUTION)).join(own.where(F.col("dtype").isin(DTYPES)), ["key", "variable"]).join(dtypes, ["dtype", "distribution"], "left")
        missing = own.join(likelihoods.select("key", "variable").distinct(), ["key", "variable"], "left_anti")
        parts.append(_issue(typed, "likelihood", "variable", [(F.col("fits").isNull(), "distribution does not fit the dtype")]))
        parts.append(_issue(missing, "likelihood", "variable", [(F.lit(True), "no likelihood")], "warning"))
    return _all(parts)


def value_fits(value: Column, kind: Column, dtype: Column) -> Column:
    """Whether an extracted value may stand for a dtype. kind: what the value was in JSON (number, integer, boolean or
    string); a null value fits any, and so does an unknown dtype."""
    number = kind.isin("number", "integer", "boolean")
    whole = kind.isin("integer", "boolean") | (kind == "number") & (value.try_cast("double") % 1 == 0) & (value.try_cast("double") >= 0)
    truth = (kind == "boolean") | kind.isin("number", "integer") & value.try_cast("double").isin(0.0, 1.0) | (kind == "string") & value.isin("0", "1", "true", "false", "True", "False")
    rule = F.when(dtype == "continuous", number).when(dtype == "binary", truth).when(dtype == "count", whole).when(dtype == "ordinal", number | (kind == "string")).when(dtype == "categorical", kind == "string")
    return value.isNull() | F.coalesce(rule, F.lit(True))


def extraction_issues(extractions: DataFrame, indicators: DataFrame) -> DataFrame:
    """extractions: key, indicator, value, kind. Unknown indicators and values that do not fit the dtype."""
    own = indicators.groupBy("key", F.col("name").alias("indicator")).agg(F.max("dtype").alias("dtype"), F.lit(True).alias("known"))
    held = extractions.join(own, ["key", "indicator"], "left")
    fits = value_fits(F.col("value"), F.col("kind"), F.col("dtype"))
    return _issue(held, "extraction", "indicator", [(F.col("known").isNull(), "unknown indicator"), (F.col("known").isNotNull() & ~fits, "value does not fit the dtype")])


def extraction_score(extractions: DataFrame, indicators: DataFrame) -> DataFrame:
    """(key, score): nothing if some value of a known indicator does not fit, else EXTRACTION_POINTS and one for each row."""
    bad = extraction_issues(extractions, indicators).where("issue = 'value does not fit the dtype'").select("key").distinct().withColumn("bad", F.lit(True))
    rows = extractions.groupBy("key").agg(F.count("*").alias("n")).join(bad, "key", "left")
    return rows.select("key", F.when(F.col("bad"), 0).otherwise(EXTRACTION_POINTS + F.col("n")).cast("bigint").alias("score"))


def latent_score(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, score, share): nothing for a specification with any issue; else three points for a construct and one more for
    a granularity, three for an edge and one more, or two across granularities. share: of four for each part, at most one."""
    wrong = latent_issues(constructs, edges).select("key").distinct().withColumn("wrong", F.lit(True))
    of_constructs = constructs.groupBy("key").agg(F.sum(F.when(F.col("granularity").isNotNull(), 4).otherwise(3)).alias("a"), F.count("*").alias("n"))
    grain = constructs.select("key", "name", "granularity")
    c, e = (grain.select("key", F.col("name").alias(side), F.col("granularity").alias(f"{side}_grain")).distinct() for side in ("cause", "effect"))
    across = ~F.col("cause_grain").eqNullSafe(F.col("effect_grain"))
    of_edges = edges.join(c, ["key", "cause"]).join(e, ["key", "effect"]).groupBy("key").agg(F.sum(F.when(across, 5).otherwise(4)).alias("b"), F.count("*").alias("m"))
    points = F.when(F.col("wrong"), 0).otherwise(F.col("a") + F.coalesce("b", F.lit(0)))
    most = 4 * (F.col("n") + F.coalesce("m", F.lit(0)))
    rows = of_constructs.join(of_edges, "key", "left").join(wrong, "key", "left")
    return rows.select("key", points.cast("bigint").alias("score"), F.least(F.lit(1.0), points / most).alias("share"))


def measurement_score(indicators: DataFrame, constructs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, score): for an indicator two points for a known construct, one each for a known dtype, for its aggregation and
    for a description of over LONG_TEXT characters; two for each further indicator of a construct; and what identifiability
    is worth. before, after: verdicts (`identify.effects`) without and with proxies. An indicator with a fault of its own
    leaves a score of nothing."""
    faults = _issue(indicators, "indicator", "name", _indicator_faults()).unionByName(_repeated(indicators, "indicator", "name")).select("key").distinct().withColumn("wrong", F.lit(True))
    own = constructs.select("key", F.col("name").alias("construct"), F.lit(True).alias("known")).distinct()
    held = indicators.join(own, ["key", "construct"], "left")
    one = F.when(F.col("known"), 2).otherwise(0) + F.col("dtype").isin(DTYPES).cast("int") + 1 + F.when(F.length("how_to_measure") > LONG_TEXT, 1).otherwise(0)
    points = held.groupBy("key").agg(F.sum(one).alias("points"))
    more = held.where("known").groupBy("key", "construct").agg((2 * (F.count("*") - 1)).alias("more")).groupBy("key").agg(F.sum("more").alias("more"))
    left = [v.where("not identifiable").groupBy("key").agg(F.count("*").alias(name)) for v, name in ((before, "first"), (after, "last"))]
    rows = points.join(more, "key", "left").join(left[0], "key", "left").join(left[1], "key", "left").join(faults, "key", "left").na.fill(0, ["more", "first", "last"])
    bonus = F.when(F.col("last") == 0, F.when(F.col("first") > 0, ALL_AFTER_PROXIES).otherwise(ALL_FROM_START)).when(F.col("first") > F.col("last"), SOME_AFTER_PROXIES).otherwise(0)
    return rows.select("key", F.when(F.col("wrong"), 0).otherwise(F.col("points") + F.col("more") + bonus).cast("bigint").alias("score"))


def _words(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")


def names_construct(construct: Column, parameter: Column) -> Column:
    """Whether a parameter's name speaks of a construct: it holds the construct's name, or at least half of the construct's
    words begin with a word of it or the other way round."""
    low, held = F.lower(construct), F.lower(parameter)
    own, said = _words(construct), F.filter(_words(F.translate(parameter, "_", " ")), lambda w: ~w.isin(NOT_NAMES))
    met = F.size(F.filter(own, lambda a: F.exists(said, lambda b: F.startswith(a, b) | F.startswith(b, a))))
    return F.contains(held, F.translate(low, " ", "_")) | F.contains(held, low) | ((F.size(own) > 0) & (2 * met >= F.size(own)))


def functional_score(constructs: DataFrame, edges: DataFrame, indicators: DataFrame, likelihoods: DataFrame, parameters: DataFrame) -> DataFrame:
    """(key, likelihood, link, own_lag, constraint, bonus, score, most, share) of how a model specification serves a causal
    one. likelihood: indicators whose distribution fits their dtype (continuous if null). link: those with a link that fits as
    well. own_lag: constructs that vary and are endogenous of which an ar_coefficient speaks. constraint: parameters with the
    constraint of their role; one of an unknown role has it. bonus: every indicator has a likelihood; there are edges, and
    for each a parameter that speaks of both ends. A variable with several likelihoods has the greatest pair of
    distribution and link. Repeated indicators, constructs and parameters count each, repeated edges once."""
    spark = constructs.sparkSession
    fits = _pairs(spark, DISTRIBUTIONS_OF_DTYPE, "dtype string, distribution string").withColumn("fits", F.lit(1))
    links = _pairs(spark, LINKS_OF_DISTRIBUTION, "distribution string, link string").withColumn("linked", F.lit(1))
    chosen = likelihoods.groupBy("key", F.col("variable").alias("name")).agg(F.max(F.struct("distribution", "link")).alias("l")).select("key", "name", "l.*", F.lit(1).alias("there"))
    held = indicators.select("key", "name", F.coalesce("dtype", F.lit("continuous")).alias("dtype")).join(chosen, ["key", "name"], "left").join(fits, ["dtype", "distribution"], "left").join(links, ["distribution", "link"], "left")
    of_indicators = held.groupBy("key").agg(
        F.count("*").alias("n_i"), F.count("fits").alias("fit"), F.count(F.when(F.col("fits") == 1, F.col("linked"))).alias("linked"), (F.count("there") == F.count("*")).alias("covered")
    )
    expected = F.create_map(*[F.lit(x) for pair in CONSTRAINT_OF_ROLE.items() for x in pair])[F.coalesce("role", F.lit(""))]
    of_parameters = parameters.groupBy("key").agg(
        F.count("*").alias("n_p"), F.count_if(expected.isNull() | F.coalesce(F.col("constraint") == expected, F.lit(False))).alias("constrained"),
        F.collect_set(F.when(F.col("role") == "ar_coefficient", F.col("name"))).alias("lags"), F.collect_set("name").alias("names"),
    )
    varying = constructs.where("temporal_status = 'time_varying' and role = 'endogenous'").join(of_parameters.select("key", "lags"), "key", "left")
    of_constructs = varying.groupBy("key").agg(F.count("*").alias("n_c"), F.count_if(F.exists("lags", lambda p: names_construct(F.col("name"), p))).alias("lagged"))
    between = edges.select("key", "cause", "effect").where("cause is not null and effect is not null").distinct().join(of_parameters.select("key", "names"), "key", "left")
    spoken = F.coalesce(F.exists("names", lambda p: names_construct(F.col("cause"), p) & names_construct(F.col("effect"), p)), F.lit(False))
    of_edges = between.groupBy("key").agg((F.count_if(spoken) == F.count("*")).alias("spoken"))
    keys = reduce(DataFrame.unionByName, [x.select("key") for x in (constructs, indicators, parameters)]).distinct()
    rows = reduce(lambda a, b: a.join(b, "key", "left"), [of_indicators, of_parameters, of_constructs, of_edges], keys)
    rows = rows.na.fill(0, ["n_i", "n_p", "n_c", "fit", "linked", "lagged", "constrained"]).na.fill({"covered": True, "spoken": False})
    bonus = F.when(F.col("covered"), ALL_INDICATORS).otherwise(0) + F.when(F.col("spoken"), ALL_EDGES).otherwise(0)
    parts = {"likelihood": FITTING * F.col("fit"), "link": LINKED * F.col("linked"), "own_lag": LAGGED * F.col("lagged"), "constraint": CONSTRAINED * F.col("constrained"), "bonus": bonus}
    most = (FITTING + LINKED) * F.col("n_i") + LAGGED * F.col("n_c") + CONSTRAINED * F.col("n_p") + ALL_INDICATORS + ALL_EDGES
    score = reduce(lambda a, b: a + b, parts.values())
    return rows.select("key", *[c.cast("bigint").alias(n) for n, c in parts.items()], score.cast("bigint").alias("score"), most.cast("bigint").alias("most"), (score / most).alias("share"))
