from math import erfc, exp, sqrt

import numpy as np

from tideline.operators import posterior, priors


def test_mixture_pooling_finds_two_opinions(spark):
    r = np.random.default_rng(2)
    two = np.concatenate([r.normal(-2, 0.1, 12), r.normal(3, 0.2, 24)])
    one = r.normal(1, 0.5, 30)
    rows = [("two", float(x), 0.3) for x in two] + [("one", float(x), 0.2) for x in one] + [("few", 1.0, 0.5), ("few", 2.0, 0.5), ("few", None, 1.0)]
    got = {x.p: x for x in priors.pool_mixture(spark.createDataFrame(rows, "p string, mu double, sigma double"), "p").collect()}
    assert got["two"].components == 2 and np.allclose(sorted(got["two"].weights), [1 / 3, 2 / 3], atol=1e-6)
    assert np.allclose(sorted(got["two"].means), [two[:12].mean(), two[12:].mean()], atol=1e-6)
    assert np.isclose(got["two"].mu, two.mean()) and np.isclose(got["two"].sigma, sqrt(two.var() + 0.09), rtol=1e-4)
    assert got["one"].components == 1 and np.isclose(got["one"].sigma, sqrt(0.04 + one.var()))
    assert got["few"].components == 1 and got["few"].mu == 1.5


def test_spread_of_a_coupled_system(spark):
    """Against the closed form of two independent states, turned into two channels each of which sees both."""
    draws = spark.createDataFrame(
        [(1, [-1.0, 0.0, 0.0, -2.0], [1.0, 0.0, 0.0, 2.0], [1.0, 1.0, 0.0, 3.0], [0.5, 0.0]), (2, [0.1, 0.0, 0.0, -1.0], [1.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 1.0], [0.0, 0.0])],
        "draw bigint, drift array<double>, diffusion array<double>, loading array<double>, noise array<double>"
    )
    got = {(x.draw, x.channel): x for x in priors.implied(draws, ["u", "v"]).collect()}
    assert np.isclose(got[1, "u"].std, sqrt(0.5 + 1.0 + 0.5)) and np.isclose(got[1, "v"].std, 3.0) and not got[2, None].stable
    checks = priors.scale_checks(priors.implied(draws, ["u", "v"]), spark.createDataFrame([("u", 1e-3), ("v", 3.0)], "channel string, std double")).collect()
    assert [(c.param, c.issue) for c in checks] == [("scale_u", "scale")]


def test_chi_square_tail():
    assert np.isclose(posterior.chi_square_tail(3.0, 2), exp(-1.5)) and np.isclose(posterior.chi_square_tail(3.0, 1), erfc(sqrt(1.5)))
    r = np.random.default_rng(3)
    for dof in (3, 4, 7, 10):
        x = (r.normal(size=(200_000, dof)) ** 2).sum(axis=1)
        assert abs((x > dof + 2).mean() - posterior.chi_square_tail(dof + 2.0, dof)) < 0.005


def test_ranks_of_a_right_and_a_wrong_model(spark):
    r = np.random.default_rng(4)
    rows = lambda shift: spark.createDataFrame([(float(r.normal()), [float(x) for x in r.normal(shift, 1, 31)]) for _ in range(300)], "truth double, draws array<double>")
    assert posterior.ranks_are_uniform(rows(0.0), 8)[1] and not posterior.ranks_are_uniform(rows(0.5), 8)[1]


def test_pareto_shape_of_known_tails(spark):
    r = np.random.default_rng(5)
    for k in (0.2, 0.5, 1.0):
        x = (r.uniform(size=4000) ** -k - 1) / k
        assert abs(posterior.pareto_shape(x) - k) < 0.1
    df = spark.createDataFrame([(float(np.log(x)),) for x in r.uniform(size=3000) ** -1.0], "w double")
    assert abs(posterior.pareto_k(df, "w", 1.0) - 1.0) < 0.45 and posterior.pareto_k(df, "w", 0.01) < 0.3
    assert posterior.pareto_k(df.limit(9), "w") is None


def test_thinning_keeps_the_ends(spark):
    got = [r.draw for r in posterior.thin(spark.range(100).withColumnRenamed("id", "draw"), 7).orderBy("draw").collect()]
    assert got == [int(j * 99 / 6) for j in range(7)]
    assert posterior.thin(spark.range(3).withColumnRenamed("id", "draw"), 7).count() == 3
