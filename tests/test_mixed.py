"""Filters of series with channels of any family: against the Kalman filter, dense grids and brute-force integrals."""

import numpy as np
import pytest

from tideline.functions import emissions, families, linear, quadrature, sampling
from tideline.functions.families import Emissions
from tideline.operators import mixed, statespace
from tideline.operators.mixed import Settings
from tideline.operators.statespace import System

A, Q, C, M0, P0 = -0.4, 0.6, 0.3, 0.5, 1.2
OTHERS = [f for f in families.FAMILIES if f != "gaussian"]


def one(sd=0.8):
    return System.one(a=[[A]], q=[[Q]], c=[C], h=[[1.0]], d=[0.1], r=[[sd**2]], m0=[M0], p0=[[P0]])


def two():
    return System.one(
        a=[[-0.5, 0.2], [0.1, -0.8]], q=[[0.4, 0.1], [0.1, 0.3]], c=[0.4, 0.2], h=[[1, 0], [0.5, 1], [0, 1]], d=[0, 0.1, 0.2], r=np.diag([0.5, 0.7, 0.3]) + 0.05, m0=[0.5, 0], p0=[[1, 0.2], [0.2, 1]]
    )


def series(family, n=12, seed=0, dts=(0.5, 1.0, 2.0)):
    rng = np.random.default_rng(seed)
    x, rows = rng.normal(M0, np.sqrt(P0)), []
    for i in range(n):
        dt = float(rng.choice(dts)) if i else 0.0
        if i:
            ad, qd, cd = (v.ravel()[0] for v in linear.discretize(np.array([[[A]]]), np.array([[[Q]]]), np.array([[C]]), dt))
            x = ad * x + cd + np.sqrt(qd) * rng.standard_normal()
        rows.append((dt, float(sampling.draw(rng, family, np.array([x + 0.1]), 0.8)[0])))
    return rows


def run(f, rows, key="s"):
    f.start(key)
    for i, (dt, y) in enumerate(rows):
        if i and dt > 0:
            f.move(dt)
        f.see(np.atleast_1d(np.asarray(y, float)))
    return f.total


def grid_loglik(family, rows, sd=0.8, size=4001, reach=12.0, **how):
    """The likelihood by sums over a dense grid of states."""
    x = np.linspace(-reach, reach, size)
    step = x[1] - x[0]
    dens = np.exp(-0.5 * (x - M0) ** 2 / P0) / np.sqrt(2 * np.pi * P0)
    total = 0.0
    for i, (dt, y) in enumerate(rows):
        if i and dt > 0:
            ad, qd, cd = (v.ravel()[0] for v in linear.discretize(np.array([[[A]]]), np.array([[[Q]]]), np.array([[C]]), dt))
            dens = np.exp(-0.5 * (x[:, None] - ad * x[None] - cd) ** 2 / qd) @ dens * step / np.sqrt(2 * np.pi * qd)
        dens = dens * np.exp(families.scores(family, y, x + 0.1, sd=sd, **how)[0])
        total += np.log(dens.sum() * step)
        dens /= dens.sum() * step
    return total


@pytest.mark.parametrize("family", families.FAMILIES)
def test_slopes_and_curvatures_are_those_of_the_density(family):
    y = {"bernoulli": 1.0, "beta": 0.3, "poisson": 3.0, "neg_binomial": 4.0, "gamma": 1.7}.get(family, 0.6)
    eta, eps = np.linspace(-3, 3, 25), 1e-4
    f = lambda e: families.scores(family, y, e, sd=0.7, df=4.0, shape=1.5, r=3.0, phi=6.0)
    dens, slope, curve, info = f(eta)
    up, down = f(eta + eps)[0], f(eta - eps)[0]
    assert np.allclose(slope, (up - down) / (2 * eps), atol=1e-5)
    assert np.allclose(curve, -(up - 2 * dens + down) / eps**2, atol=1e-4)
    assert (info >= 0).all()


def test_information_is_the_mean_curvature():
    eta = np.array([-0.7, 0.4])
    y = np.arange(400.0)
    for family in ("poisson", "neg_binomial"):
        d = np.stack([families.scores(family, v, eta)[0] for v in y])
        c = np.stack([families.scores(family, v, eta)[2] for v in y])
        assert np.allclose((np.exp(d) * c).sum(axis=0), families.scores(family, 0.0, eta)[3], rtol=1e-6)
    x = np.linspace(1e-5, 1 - 1e-5, 20001)
    d = np.stack([families.scores("beta", v, eta)[0] for v in x])
    c = np.stack([families.scores("beta", v, eta)[2] for v in x])
    assert np.allclose((np.exp(d) * c).sum(axis=0) * (x[1] - x[0]), families.scores("beta", 0.5, eta)[3], rtol=1e-3)


def test_densities_equal_those_of_the_columns(spark):
    from pyspark.sql import functions as F

    rows = [(y, float(e)) for y in (0.2, 0.7) for e in np.linspace(-3, 3, 7)]
    df = spark.createDataFrame(rows, "y double, eta double")
    for family in families.FAMILIES:
        got = [r[0] for r in df.select(emissions.log_density(family, F.col("y"), F.col("eta"))).collect()]
        assert np.allclose(got, [families.scores(family, y, np.array(e))[0] for y, e in rows], atol=1e-8)


def test_impossible_observations_have_no_density():
    eta = np.array([0.0, 1.0])
    for family, y in (("poisson", -1.0), ("neg_binomial", -2.0), ("gamma", -0.1), ("beta", 0.0), ("beta", 1.0), ("bernoulli", 2.0)):
        assert (families.scores(family, y, eta)[0] == -np.inf).all()
    assert np.isfinite(families.scores("gamma", 0.0, eta)[0]).all()
    assert (families.scores("gamma", 0.0, eta, shape=2.0)[0] == -np.inf).all()
    f = mixed.Mixed(one(), Emissions(["beta"]), Settings())
    assert run(f, [(0, 0.4), (1, 1.0), (1, 0.5)]) == -np.inf and np.isfinite(f.m).all()
    with pytest.raises(ValueError, match="unknown family"):
        Emissions(["cauchy"])


def test_rules_integrate_polynomials():
    x, w = quadrature.gauss_hermite(5)
    assert np.isclose(w.sum(), 1) and np.isclose((w * x**2).sum(), 1) and np.isclose((w * x**8).sum(), 105)
    for dim in (1, 2, 3):
        u, w = quadrature.rule(dim, 5)
        assert u.shape == (5**dim, dim) and np.isclose((w * (u**2).prod(axis=1)).sum(), 1)
        u, w = quadrature.rule(dim, 5, "unscented")
        assert u.shape == (2 * dim + 1, dim) and np.allclose(w @ u, 0) and np.allclose((w[:, None] * u).T @ u, np.eye(dim)) and np.isclose(w.sum(), 1)
    assert len(quadrature.rule(8, 12)[0]) == 17
    with pytest.raises(ValueError):
        quadrature.rule(1, 5, "simpson")


@pytest.mark.parametrize("how", [Settings(), Settings(particles=7), Settings(particles=5, exact=True)])
def test_normal_channels_give_the_kalman_filter(how):
    rows = [(0, [0.3, 0.8, np.nan]), (1.0, [np.nan, 0.2, 0.4]), (0.0, [0.1, np.nan, np.nan]), (2.5, [np.nan] * 3), (0.3, [1.0, -1.0, 2.0])]
    assert np.allclose(run(mixed.Mixed(two(), Emissions(["gaussian"] * 3), how), rows), run(mixed.Kalman(two()), rows), atol=1e-9)


@pytest.mark.parametrize("family", OTHERS)
def test_one_observation_is_the_integral(family):
    """The rule around the peak is exact for the first row; so is what the grid gives."""
    for _, y in series(family, 6, seed=4):
        got = run(mixed.Mixed(one(), Emissions([family]), Settings(points=30)), [(0.0, y)])
        assert abs(got - grid_loglik(family, [(0.0, y)])) < 1e-3


@pytest.mark.parametrize("family", OTHERS)
def test_series_are_near_the_grid(family):
    """Moments alone: within a hundredth an observation; drawn predictors: without bias, so within their own error."""
    rows = series(family, 12, seed=1)
    want = grid_loglik(family, rows)
    assert abs(run(mixed.Mixed(one(), Emissions([family]), Settings()), rows) - want) < 0.01 * len(rows)
    got = run(mixed.Mixed(one(), Emissions([family]), Settings(particles=6000, exact=True)), rows)
    assert abs(got - want) < 0.05


def test_log_concave_series_are_within_a_thousandth_of_the_grid():
    for family in ("poisson", "bernoulli", "neg_binomial"):
        gaps = []
        for seed in range(4):
            rows = series(family, 12, seed=seed)
            gaps.append(abs(run(mixed.Mixed(one(), Emissions([family]), Settings()), rows)[0] - grid_loglik(family, rows)) / len(rows))
        assert np.mean(gaps) < 1e-3, (family, gaps)


def test_channels_of_several_families_equal_a_plane_of_points():
    """Two latent variables, three channels of which two are not normal, one row: against a sum over a plane."""
    s, e = two(), Emissions(["poisson", "gaussian", "bernoulli"])
    s.r[:] = np.diag([1, 0.7, 1])
    y = [2.0, 0.4, 1.0]
    x = np.stack(np.meshgrid(np.linspace(-8, 8, 801), np.linspace(-8, 8, 801), indexing="ij"), axis=-1).reshape(-1, 2)
    gap = x - s.m0[0]
    dens = -0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s.p0[0]), gap) - 0.5 * np.linalg.slogdet(2 * np.pi * s.p0[0])[1]
    for j, family in enumerate(e.families):
        dens = dens + families.scores(family, y[j], x @ s.h[0, j] + s.d[0, j], sd=np.sqrt(0.7))[0]
    want = np.log(np.exp(dens).sum() * 0.02**2)
    f = mixed.Mixed(s, e, Settings(points=20))
    assert abs(run(f, [(0, y)])[0] - want) < 1e-4
    w = np.exp(dens) / np.exp(dens).sum()
    mean = w @ x
    assert np.allclose(f.m[0, 0], mean, atol=1e-4) and np.allclose(f.p[0, 0], (w[:, None] * (x - mean)).T @ (x - mean), atol=1e-3)
    rough = run(mixed.Mixed(s, e, Settings(rule="unscented")), [(0, y)])[0]
    assert abs(rough - want) < 0.05


def test_block_filter_draws_less_and_means_the_same():
    """Sampling one of two variables, both, or none: the same likelihood within error, and less of it for fewer."""
    rows = [(0.5, v) for v in np.random.default_rng(2).normal(0.5, 1, (25, 3)).tolist()]
    e = Emissions(["gaussian"] * 3)
    want = run(mixed.Kalman(two()), rows)[0]
    assert run(mixed.Mixed(two(), e, Settings(particles=3, sampled=[])), rows)[0] == pytest.approx(want, abs=1e-9)
    spread = {}
    for sampled in ([1], [0, 1]):
        got = [run(mixed.Mixed(two(), e, Settings(particles=400, sampled=sampled, seed=k)), rows)[0] for k in range(12)]
        spread[len(sampled)] = np.std(got)
        assert abs(np.log(np.mean(np.exp(np.array(got) - want)))) < 0.4
    assert spread[1] < spread[2]


def test_noise_of_students_t():
    """Many degrees of freedom are normal noise; few give the likelihood of a grid with that noise (over one step of dt, where
    the scale of the discretised noise is what is drawn)."""
    rows = [(1.0, v) for v in (0.2, 3.5, 0.1, -2.0)]
    e = Emissions(["gaussian"])
    many = run(mixed.Mixed(one(), e, Settings(particles=4000, df=[1e7])), rows)[0]
    assert many == pytest.approx(run(mixed.Kalman(one()), rows)[0], abs=5e-3)
    df, x = 4.0, np.linspace(-25, 25, 5001)
    step = x[1] - x[0]
    ad, qd, cd = (v.ravel()[0] for v in linear.discretize(np.array([[[A]]]), np.array([[[Q]]]), np.array([[C]]), 1.0))
    dens, total = np.exp(-0.5 * (x - M0) ** 2 / P0) / np.sqrt(2 * np.pi * P0), 0.0
    sd = np.sqrt(qd * (df - 2) / df)
    for i, (_, y) in enumerate(rows):
        if i:
            dens = np.exp(families.scores("student_t", 0.0, x[:, None] - ad * x[None] - cd, sd=sd, df=df)[0]) @ dens * step
        dens = dens * np.exp(families.scores("gaussian", y, x + 0.1, sd=0.8)[0])
        total += np.log(dens.sum() * step)
        dens /= dens.sum() * step
    for sampled in ([], [0]):
        got = [run(mixed.Mixed(one(), e, Settings(particles=5000, df=[df], sampled=sampled, seed=k)), rows)[0] for k in range(3)]
        assert np.mean(got) == pytest.approx(total, abs=0.05)


def three():
    """A normal pair of variables, and a third apart from it with a count."""
    return System.one(
        a=[[-0.5, 0.2, 0], [0.1, -0.8, 0], [0, 0, -0.4]], q=np.diag([0.4, 0.3, 0.5]), c=[0.4, 0.2, 0.1], h=[[1, 0, 0], [0.5, 1, 0], [0, 0, 1]], d=[0, 0.1, 0.2], r=np.diag([0.5, 0.7, 1.0]), m0=[0.5, 0, 0.3], p0=np.eye(3)
    )


def test_partition_and_backend():
    effects, loads = three().a[0] != 0, three().h[0] != 0
    split = mixed.blocks(effects, loads, ["gaussian", "gaussian", "poisson"])
    assert (split.latents, split.channels, split.others, split.other_channels) == ([0, 1], [0, 1], [2], [2])
    assert mixed.backend(["gaussian", "gaussian", "poisson"], split) == "composed"
    odd = mixed.blocks(effects, loads, ["gaussian"] * 3, [None, 5.0, None])
    assert (odd.latents, odd.channels) == ([2], [2]) and mixed.backend(["gaussian"] * 3, odd, [None, 5.0, None]) == "composed"
    loads[1, 2] = True  # a shared channel ties the blocks together
    tied = mixed.blocks(effects, loads, ["gaussian", "gaussian", "poisson"])
    assert tied.latents == [] and mixed.backend(["gaussian", "gaussian", "poisson"], tied) == "mixed"
    assert mixed.backend(["gaussian"] * 3, tied) == "kalman"


def test_composed_is_the_sum_of_both_sides(spark):
    rng = np.random.default_rng(3)
    rows = [(k, 0.7 * i, *rng.normal(0.3, 1, 2).tolist(), float(rng.poisson(1.5))) for k in range(5) for i in range(8)]
    rows[3] = (*rows[3][:3], None, None)
    panel = statespace.sort_panel(spark.createDataFrame(rows, "k long, t double, a double, b double, c double"), "k", "t")
    e = Emissions(["gaussian", "gaussian", "poisson"])
    split = mixed.blocks(three().a[0] != 0, three().h[0] != 0, e.families)
    of = lambda df: {r.k: r.loglik for r in df.collect()}
    both = of(mixed.composed_loglik(panel, three(), e, split, "k", "t", ["a", "b", "c"]))
    left = of(statespace.loglik(panel, mixed.only(three(), [0, 1], [0, 1]), "k", "t", ["a", "b"]))
    right = of(mixed.rb_loglik(panel, mixed.only(three(), [2], [2]), e.of([2]), "k", "t", ["c"]))
    whole = of(mixed.rb_loglik(panel, three(), e, "k", "t", ["a", "b", "c"]))
    assert all(both[k] == pytest.approx(left[k] + right[k], abs=1e-9) == pytest.approx(whole[k], abs=1e-6) for k in range(5))


def test_batches_and_shapes_of_their_own_and_the_same_rows_again(spark):
    rows = [(k, float(i), float((k * i) % 4)) for k in range(4) for i in range(6)]
    panel = statespace.sort_panel(spark.createDataFrame(rows, "k long, t double, y double"), "k", "t")
    wide = System(*[np.concatenate([getattr(one(), f), getattr(one(), f)]) for f in ("a", "q", "c", "h", "d", "r", "m0", "p0")])
    wide.c[1] = 0.9
    e = Emissions(["neg_binomial"], {"r": [[5.0], [2.0]]})
    how = Settings(particles=50, exact=True)
    got = {(r.k, r.system): r.loglik for r in mixed.rb_loglik(panel, wide, e, "k", "t", ["y"], how).collect()}
    again = {(r.k, r.system): r.loglik for r in mixed.rb_loglik(panel, wide, e, "k", "t", ["y"], how).collect()}
    assert got == again and len(got) == 8
    alone = {r.k: r.loglik for r in mixed.rb_loglik(panel, one(), Emissions(["neg_binomial"]), "k", "t", ["y"], how).collect()}
    assert all(got[k, 0] == pytest.approx(alone[k], abs=1e-9) and got[k, 1] != pytest.approx(alone[k]) for k in range(4))
    assert mixed.rb_loglik(panel.where("k < 0"), one(), e, "k", "t", ["y"]).count() == 0
