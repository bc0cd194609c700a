"""A sound specification has no issues and the points it should have; each fault is found by name."""

import pytest

from tideline.operators import identify, specs

CONSTRUCTS = [
    ("Stress", "exogenous", "time_varying", "daily", False), ("Fatigue", "endogenous", "time_varying", "daily", False),
    ("Trait", "exogenous", "time_invariant", None, False), ("Focus", "endogenous", "time_varying", "hourly", True)
]
EDGES = [("Stress", "Fatigue", False), ("Fatigue", "Focus", True), ("Trait", "Focus", False), ("Focus", "Fatigue", True)]
INDICATORS = [("s1", "Stress", "daily", "continuous", "mean", "short"), ("s2", "Stress", "hourly", "count", "sum", "x" * 51), ("f1", "Focus", "finest", "binary", "last", None)]


def constructs(spark, rows=CONSTRUCTS, key="a"):
    return spark.createDataFrame([(key, *r) for r in rows], "key string, name string, role string, temporal_status string, granularity string, is_outcome boolean")


def edges(spark, rows=EDGES, key="a"):
    return spark.createDataFrame([(key, *r) for r in rows], "key string, cause string, effect string, lagged boolean")


def indicators(spark, rows=INDICATORS, key="a"):
    return spark.createDataFrame([(key, *r) for r in rows], "key string, name string, construct string, granularity string, dtype string, aggregation string, how_to_measure string")


def found(df):
    return sorted((r.name, r.issue, r.severity) for r in df.collect())


def test_a_sound_specification_scores(spark):
    c, e, i = constructs(spark), edges(spark), indicators(spark)
    assert found(specs.causal_issues(c, e, i)) == []
    row = specs.latent_score(c, e).first()
    assert row.score == (4 + 4 + 3 + 4) + (4 + 5 + 5 + 5) and row.share == 1.0
    none = spark.createDataFrame([], identify.VERDICT)
    bad = spark.createDataFrame([("a", "t", False, None, [], [], [], None)] * 2, identify.VERDICT)
    score = lambda first, last: specs.measurement_score(i, c, first, last).first().score
    points = (2 + 1 + 1) + (2 + 1 + 1 + 1) + (2 + 1 + 1) + 2
    assert [score(none, none), score(bad, none), score(bad, bad.limit(1)), score(bad, bad)] == [points + 10, points + 15, points + 5, points]


@pytest.mark.parametrize(
    "replace, want",
    [
        ({0: ("Stress", "exogenous", "time_varying", None, False)}, [("Stress", "granularity missing"), ("Stress -> Fatigue", "unknown cause")]),
        ({0: ("Stress", "exogenous", "time_varying", "minutely", False)}, [("Stress", "unknown granularity"), ("Stress -> Fatigue", "unknown cause")]),
        ({2: ("Trait", "exogenous", "time_invariant", "daily", False)}, [("Trait", "granularity not allowed"), ("Trait -> Focus", "unknown cause")]),
        ({1: ("Fatigue", "exogenous", "time_varying", "daily", False)}, [("Focus -> Fatigue", "exogenous effect"), ("Stress -> Fatigue", "exogenous effect")]),
        ({1: ("Fatigue", "endogenous", "time_varying", "weekly", False)}, [("Stress -> Fatigue", "grains differ")]),
        ({3: ("Focus", "endogenous", "time_varying", "hourly", False)}, [("", "no outcome")]),
        ({1: ("Fatigue", "endogenous", "time_varying", "daily", True)}, [("", "several outcomes")]),
    ],
)
def test_faults_of_constructs(spark, replace, want):
    rows = [replace.get(k, r) for k, r in enumerate(CONSTRUCTS)]
    got = found(specs.latent_issues(constructs(spark, rows), edges(spark)))
    assert [g[:2] for g in got] == want
    assert specs.latent_score(constructs(spark, rows), edges(spark)).first().score == 0


def test_faults_of_edges_and_names(spark):
    rows = [("Fatigue", "Focus", True), ("Fatigue", "Ghost", False), ("Nobody", "Focus", False), ("Fatigue", "Rest", False), ("Rest", "Fatigue", False)]
    c = constructs(spark, [*CONSTRUCTS, ("Rest", "endogenous", "time_varying", "daily", False), CONSTRUCTS[0]])
    got = [g[:2] for g in found(specs.latent_issues(c, edges(spark, rows)))]
    assert got == [("Fatigue", "contemporaneous cycle"), ("Fatigue -> Ghost", "unknown effect"), ("Nobody -> Focus", "unknown cause"), ("Stress", "duplicate name")]
    alone = found(specs.latent_issues(constructs(spark), edges(spark, [("Stress", "Fatigue", False)])))
    assert [g[:2] for g in alone] == [("Focus", "outcome without cause")]


def test_faults_of_indicators(spark):
    rows = [
        ("a", "Stress", "weekly", "continuous", "mean", ""), ("b", "Nobody", "daily", "continuous", "mean", ""),
        ("c", "Focus", "daily", "text", "mode", ""), ("d", "Trait", "yearly", "count", "sum", ""), ("d", "Trait", "monthly", "count", "sum", "")
    ]
    got = [g[:2] for g in found(specs.measurement_issues(indicators(spark, rows), constructs(spark)))]
    assert got == [("a", "coarser than its construct"), ("b", "unknown construct"), ("c", "unknown aggregation"), ("c", "unknown dtype"), ("d", "duplicate name")]


def test_faults_of_models(spark):
    likelihoods = spark.createDataFrame(
        [("a", "s1", "gaussian", "identity"), ("a", "s2", "gaussian", "log"), ("a", "s2", "cauchy", "cloglog")],
        "key string, variable string, distribution string, link string"
    )
    parameters = spark.createDataFrame(
        [("a", "rho", "ar_coefficient", "none"), ("a", "rho", "loading", "positive"), ("a", "x", "odd", "loose")],
        "key string, name string, role string, constraint string"
    )
    got = found(specs.model_issues(likelihoods, parameters, indicators(spark)))
    assert got == [
        ("f1", "no likelihood", "warning"), ("rho", "duplicate name", "error"), ("rho", "unexpected constraint", "warning"), ("s2", "distribution does not fit the dtype", "error"), ("s2", "duplicate name", "error"),
        ("s2", "link does not fit the distribution", "error"), ("s2", "unknown distribution", "error"), ("s2", "unknown link", "error"), ("x", "unknown constraint", "error"), ("x", "unknown role", "error"),
    ]


def test_extractions(spark):
    rows = [
        ("a", "s1", "2.5", "number"), ("a", "s2", "-1", "number"), ("a", "s2", "3", "integer"), ("a", "f1", "yes", "string"), ("a", "f1", None, None),
        ("a", "ghost", "1", "integer"), ("b", "s1", "1", "integer")
    ]
    x = spark.createDataFrame(rows, "key string, indicator string, value string, kind string")
    known = indicators(spark).unionByName(indicators(spark, key="b"))
    assert [g[:2] for g in found(specs.extraction_issues(x, known))] == [("f1", "value does not fit the dtype"), ("ghost", "unknown indicator"), ("s2", "value does not fit the dtype")]
    assert {r.key: r.score for r in specs.extraction_score(x, known).collect()} == {"a": 0, "b": 11}


def test_functional_score(spark):
    constructs = spark.createDataFrame([("a", "cognitive focus", "endogenous", "time_varying"), ("a", "mood", "endogenous", "time_varying"), ("a", "age", "exogenous", "time_invariant"), ("b", "x", "endogenous", "time_varying")], "key string, name string, role string, temporal_status string")
    edges = spark.createDataFrame([("a", "age", "mood"), ("a", "age", "mood"), ("a", "mood", "cognitive focus")], "key string, cause string, effect string")
    indicators = spark.createDataFrame([("a", "steps", "count"), ("a", "tone", None), ("a", "flag", "binary")], "key string, name string, dtype string")
    likelihoods = spark.createDataFrame([("a", "steps", "poisson", "identity"), ("a", "tone", "gaussian", "identity"), ("a", "flag", "gaussian", "identity"), ("b", "y", "gamma", "log")], "key string, variable string, distribution string, link string")
    params = spark.createDataFrame([("a", "ar_cog", "ar_coefficient", "unit_interval"), ("a", "beta_mood_age", "fixed_effect", "positive"), ("a", "beta_mood_cog", "fixed_effect", "none"), ("a", "odd", "unheard", None)], "key string, name string, role string, constraint string")
    got = {r.key: tuple(r)[1:] for r in specs.functional_score(constructs, edges, indicators, likelihoods, params).collect()}
    assert got["a"] == (4, 1, 3, 3, 8, 19, 27, pytest.approx(19 / 27))
    assert got["b"] == (0, 0, 0, 0, 5, 5, 11, pytest.approx(5 / 11))
    assert specs.functional_score(*[x.where("key = 'c'") for x in (constructs, edges, indicators, likelihoods, params)]).count() == 0
