"""Draws by key: their distributions, that they repeat, and systems made of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import chance
from tideline.operators import prior_draws, priors, statespace


def sample(spark, column, n=20_000):
    return spark.range(n).select(column.alias("x")).toPandas().x.to_numpy()


def test_distributions(spark):
    key = F.col("id")
    u = sample(spark, chance.uniform(key, "u"))
    assert 0 < u.min() and u.max() < 1 and np.abs(np.sort(u) - np.linspace(0, 1, len(u))).max() < 0.015
    z = sample(spark, chance.normal(key, "z", 1.0, 2.0))
    assert z.mean() == pytest.approx(1, abs=0.06) and z.std() == pytest.approx(2, rel=0.02) and ((z - 1) ** 4).mean() / 16 == pytest.approx(3, rel=0.1)
    assert sample(spark, chance.half_normal(key, "h", 2.0)).mean() == pytest.approx(2 * (2 / np.pi) ** 0.5, rel=0.02)
    for shape, rate in ((0.4, 1.0), (1.0, 2.0), (2.0, 0.5), (9.0, 3.0)):
        g = sample(spark, chance.gamma(key, "g", shape, rate))
        assert g.min() > 0 and g.mean() == pytest.approx(shape / rate, rel=0.04) and g.var() == pytest.approx(shape / rate**2, rel=0.08)
        assert np.mean(g < shape / rate) == pytest.approx(np.mean(np.random.default_rng(0).gamma(shape, 1 / rate, 200_000) < shape / rate), abs=0.012)
    t = sample(spark, chance.truncated(key, "t", 0.0, 1.0, 0.5, 1.0))
    own = np.random.default_rng(1).standard_normal(400_000)
    assert t.min() >= 0.5 and t.max() <= 1.0 and t.mean() == pytest.approx(own[(own > 0.5) & (own < 1)].mean(), abs=0.004)
    far = sample(spark, chance.truncated(key, "f", 0.0, 1.0, 40.0, 41.0), 500)
    assert far.min() >= 40 and far.max() <= 41


def test_draws_repeat_and_are_apart(spark):
    key = F.col("id")
    a, b = sample(spark, chance.standard(key, "a")), sample(spark, chance.standard(key, "b"))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.02 and abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.02
    again = spark.range(20_000).repartition(7).select("id", chance.standard(key, "a").alias("x")).orderBy("id").toPandas().x.to_numpy()
    assert (a == again).all()


def test_systems(spark):
    keys = spark.createDataFrame([(k,) for k in [*range(3000), None, 5]], "draw long")
    out = prior_draws.systems(
        keys, ["A", "B", "T"], [("A", "B"), ("T", "A")], ["x", "k"], {("x", "A"): 1.0, ("k", "B"): None}, still=("T",), means=("k",), families=["gaussian", "neg_binomial"],
        priors={"effect_B_A": {"mu": 3.0, "sigma": 0.1}, "loading": {"mu": 0.0, "sigma": 1.0, "lower": 0.5, "upper": 2.0}},
    )
    rows = out.collect()
    assert len(rows) == 3001 and sum(r.draw == 5 for r in rows) == 2 and len({tuple(r.drift) for r in rows}) == 3000
    a = np.array([r.drift for r in rows]).reshape(-1, 3, 3)
    assert (a[:, 0, 0] < 0).all() and (a[:, 2, 2] == -prior_draws.STILL).all() and (a[:, 0, 1] == 0).all() and (a[:, 2, :2] == 0).all()
    assert a[:, 1, 0].mean() == pytest.approx(3, abs=0.02) and a[:, 0, 2].std() == pytest.approx(0.5, rel=0.08)
    load = np.array([r.loading for r in rows])
    assert (load[:, 0] == 1).all() and load[:, 4].min() >= 0.5 and load[:, 4].max() <= 2 and (load[:, [1, 2, 3, 5]] == 0).all()
    shapes = [r.shapes for r in rows]
    assert all(s[0] is None for s in shapes) and np.mean([s[1] for s in shapes]) == pytest.approx(4, rel=0.06)
    assert {r.cint[2] for r in rows} == {0.0} and {r.mean[0] for r in rows} == {0.0} and {r.noise[1] for r in rows} == {0.0}


def test_systems_feed_replicates_and_checks(spark):
    keys = spark.range(400).withColumnRenamed("id", "draw")
    out = prior_draws.systems(keys, ["A"], [], ["x", "k"], {("x", "A"): 1.0, ("k", "A"): 1.0}, families=["gaussian", "neg_binomial"])
    made = statespace.predictive(out, [0.0, 1.0, 2.0], ["x", "k"], ["gaussian", "neg_binomial"])
    assert made.count() == 400 * 6 and made.where("variable = 'k' and (value < 0 or value <> floor(value))").count() == 0
    again = statespace.predictive(out.repartition(5), [0.0, 1.0, 2.0], ["x", "k"], ["gaussian", "neg_binomial"])
    assert made.exceptAll(again).count() == 0
    assert priors.implied(out.withColumn("noise", F.transform("noise", lambda x: x * x)), ["x", "k"]).where("stable").count() == 800
    long = prior_draws.long_rows(out, {"drift": ["drift_A"], "shapes": [None, "r"]})
    assert {r.param: r["count"] for r in long.groupBy("param").count().collect()} == {"drift_A": 400, "r": 400}
    assert priors.value_checks(long, ["r"]).count() == 0
