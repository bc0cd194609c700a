"""Samplers against densities that are known, and fits of channels that are not normal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import families
from tideline.lineage import cut
from tideline.operators import inference, mixed, statespace


def correlated(dim=6, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((dim, dim))
    cov, mean = a @ a.T / dim + 0.3 * np.eye(dim), rng.standard_normal(dim)
    inv = np.linalg.inv(cov)

    def density(z):
        gap = z - mean
        return -0.5 * np.einsum("ij,jk,ik->i", gap, inv, gap), -gap @ inv

    return mean, cov, density


def test_nuts_has_the_moments_of_a_correlated_normal():
    mean, cov, density = correlated()
    made, told = inference.nuts_chains(density, np.zeros((16, 6)), steps=400, warm=200, seed=3)
    flat = made.reshape(-1, 6)
    assert np.allclose(flat.mean(axis=0), mean, atol=0.1) and np.allclose(np.cov(flat.T), cov, atol=0.15)
    assert told["diverged"] == 0 and 1 <= told["depth"] <= 5


def test_nuts_goes_as_far_as_it_pays():
    """A long narrow density needs deeper trees than a round one; steps of one fast period would leave 0.98 of a draw in the
    next."""
    scale = np.array([1.0, 30.0])

    def density(z):
        return -0.5 * ((z / scale) ** 2).sum(axis=1), -z / scale**2

    made, told = inference.nuts_chains(density, np.zeros((8, 2)), steps=300, warm=150, seed=5)
    _, around = inference.nuts_chains(lambda z: (-0.5 * (z**2).sum(axis=1), -z), np.zeros((8, 2)), steps=100, warm=100, seed=5)
    wide = made[:, :, 1] - made[:, :, 1].mean()
    assert told["depth"] > around["depth"] + 1
    assert wide.std() == pytest.approx(30, rel=0.15) and abs((wide[1:] * wide[:-1]).mean() / wide.var()) < 0.85


def test_nuts_is_lost_where_the_density_is():
    made, told = inference.nuts_chains(lambda z: (np.where(np.abs(z[:, 0]) < 1, 0.0, -np.inf), np.zeros_like(z)), np.zeros((4, 1)), steps=200, warm=50, seed=2)
    assert (np.abs(made) < 1).all() and told["diverged"] > 0 and made.std() == pytest.approx(3**-0.5, abs=0.1)


@pytest.fixture(scope="module")
def known(spark):
    """A panel with a known system, and its posterior's mean by the normal approximation."""
    truth = statespace.System.one(a=[[-0.5]], q=[[0.36]], c=[0.8], h=[[1]], d=[0], r=[[0.16]], m0=[0], p0=[[1]])
    made = statespace.simulate(spark, truth, 24, 40, 0.5, seed=3).withColumnRenamed("y0", "y")
    target = inference.Target(cut(statespace.sort_panel(made, "series", "t")), inference.one_latent(), "series", "t", ["y"])
    centre, curve = inference.mode(target)
    return target, centre, np.sqrt(np.diag(np.linalg.inv(curve)))


def moments(target, df):
    rows = df.groupBy("param").agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).toPandas().set_index("param")
    return np.array([rows.m[n] for n in target.model.names]), np.array([rows.s[n] for n in target.model.names])


@pytest.mark.parametrize("method, how", [
    ("nuts", {"chains": 8, "steps": 25, "warm": 15}),
    ("tempered_smc", {"particles": 96, "moves": 4}),
    ("tempered_smc", {"particles": 48, "moves": 3, "waste_free": False, "leaps": 2}),
    ("svi", {"steps": 120, "rate": 0.1}),
    ("svi", {"steps": 120, "guide": "normal", "rate": 0.1}),
    ("svi", {"steps": 150, "parts": 3, "rate": 0.1}),
    ("svi", {"steps": 100, "guide": "delta", "rate": 0.1}),
])
def test_methods_agree_on_a_small_posterior(known, method, how):
    target, centre, sd = known
    natural = target.model.natural(centre[None])[0]
    slope = np.abs(target.model.natural((centre + 1e-4)[None])[0] - natural) / 1e-4
    mean, spread = moments(target, inference.fit(target, method, **how))
    assert (np.abs(mean - natural) < (1.5 if method == "svi" else 1.0) * sd * slope + 0.02).all(), (mean, natural, sd * slope)
    if how.get("guide") not in ("normal", "delta"):
        assert (spread > 0.3 * sd * slope).all() and (spread < 3 * sd * slope).all()


def test_bad_settings_fail(known):
    target = known[0]
    with pytest.raises(ValueError, match="divide"):
        inference.tempered_smc(target, particles=10, moves=4)
    with pytest.raises(ValueError, match="guide"):
        inference.svi(target, "laplace")
    with pytest.raises(ValueError, match="likelihood"):
        inference.Target(target.panel, target.model, *target.on, likelihood="bootstrap")
    with pytest.raises(ValueError, match="normal channels"):
        inference.Target(target.panel, inference.structural(["A"], [], ["y"], {("y", "A"): 1.0}, families=["poisson"]), *target.on, likelihood="kalman")


def test_shapes_are_parameters_and_enter_the_density():
    model = inference.structural(["A"], [], ["x", "y", "z"], {("x", "A"): 1.0, ("y", "A"): None, ("z", "A"): 1.0}, families=["neg_binomial", "student_t", "poisson"], starts=True)
    assert model.names == ["drift_A", "diffusion_A", "cint_A", "loading_y_A", "noise_y", "r_x", "df_y", "start_A", "spread_A"]
    t = np.linspace(-0.4, 0.5, 9)[None]
    e, s, n = model.emissions(t), model.build(t), dict(zip(model.names, model.natural(t)[0]))
    assert e.shapes["r"][0, 0] == n["r_x"] and e.shapes["df"][0, 1] == n["df_y"] and e.shapes["r"][0, 2] == families.DEFAULTS["r"]
    assert s.m0[0, 0] == n["start_A"] and s.p0[0, 0, 0] == pytest.approx(n["spread_A"] ** 2) and s.r[0, 1, 1] == pytest.approx(n["noise_y"] ** 2)
    draws = np.random.default_rng(0).gamma(5, 1, 200_000)
    assert inference.KINDS["df"] == pytest.approx((np.log(draws).mean(), np.log(draws).std()), abs=0.01)


@pytest.mark.parametrize("likelihood", ["mixed", "laplace"])
def test_counts_are_fitted(spark, likelihood):
    """Drift, noise and level of a process that is seen through counts alone."""
    truth = statespace.System.one(a=[[-0.6]], q=[[0.25]], c=[0.6], h=[[1]], d=[0], r=[[1.0]], m0=[0], p0=[[1]])
    made = statespace.simulate(spark, truth, 25, 30, 0.5, family="poisson", seed=1).withColumnRenamed("y0", "y")
    model = inference.structural(["A"], [], ["y"], {("y", "A"): 1.0}, families=["poisson"])
    target = inference.Target(cut(statespace.sort_panel(made, "series", "t")), model, "series", "t", ["y"], likelihood)
    assert inference.Target(target.panel, model, *target.on).likelihood == "mixed"
    mean, sd = moments(target, inference.fit(target, "laplace", n=300))
    assert (np.abs(mean - [-0.6, 0.5, 0.6]) < 2.5 * sd).all() and (sd < 0.25).all()


def test_parts_of_a_batch_are_the_batch(known):
    target = known[0]
    theta = target.model.mean + 0.2 * np.random.default_rng(0).standard_normal((5, 4))
    apart = inference.Target(target.panel, target.model, *target.on, spread=3)
    assert np.allclose(apart(theta), target(theta))
    for a, b in zip(apart.value_and_slope(theta), target.value_and_slope(theta)):
        assert np.allclose(a, b)
    far = np.concatenate([theta[:1], theta[:1] + 1e3])
    assert target(far)[1] == -1e30 and target.value_and_slope(far)[0][1] == -1e30
    assert mixed.backend(["gaussian"], target.split) == target.likelihood == "kalman"


@pytest.mark.parametrize("kind", ["hessian", "mala", "rw"])
def test_weights_of_proposals_without_rejection(known, kind):
    """Few dimensions: weighted draws have the posterior's mean, and second derivatives keep more of the particles."""
    target, centre, sd = known
    size = {"hessian": 0.9, "mala": 0.04, "rw": 0.2}[kind]
    rows = inference.fit(target, "hess_mc2", kind=kind, particles=96, steps=8, size=size).toPandas()
    assert rows.groupby("param").weight.sum().to_numpy() == pytest.approx(1)
    natural = target.model.natural(centre[None])[0]
    slope = np.abs(target.model.natural((centre + 1e-4)[None])[0] - natural) / 1e-4
    mean = rows.assign(x=rows.value * rows.weight).groupby("param").x.sum()[target.model.names].to_numpy()
    assert (np.abs(mean - natural) < (1.5 if kind == "hessian" else 3) * sd * slope).all()
    if kind == "hessian":
        assert np.mean([ess for _, _, ess in inference.hess_steps(target, kind, 96, 8, size)[4:]]) > 25
    with pytest.raises(ValueError, match="proposal"):
        inference.hess_steps(target, "newton")
