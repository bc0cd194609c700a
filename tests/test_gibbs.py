"""Particle Gibbs: paths against the smoother, densities against plain sums, and a posterior that is known."""

import numpy as np
import pytest

from tests.test_mixed import one, series, three, two
from tests.test_modes import frame
from tideline.functions import linear
from tideline.functions.families import Emissions, scores
from tideline.operators import gibbs, inference, slopes, statespace
from tideline.operators.statespace import System


def repeated(s: System, times: int) -> System:
    return System(*[np.repeat(getattr(s, f), times, axis=0) for f in slopes.FIELDS])


def test_paths_have_the_moments_of_the_smoother(spark):
    """Many chains of few particles, conditioned on their last paths again and again."""
    rng = np.random.default_rng(1)
    groups = {k: [(float(rng.choice([0.5, 1.3])) if i else 0.0, np.where(rng.random(3) < 0.2, np.nan, rng.normal(0.5, 1, 3))) for i in range(8)] for k in range(2)}
    ys, e, chains = ["a", "b", "c"], Emissions(["gaussian"] * 3), 600
    panel = frame(spark, groups, ys)
    paths, s = panel, repeated(two(), chains)
    for n in range(6):
        paths = gibbs.swept(paths, s, e, "k", "t", ys, 5, [3, n])
    want = {(r.k, r.t): r for r in statespace.smoothed(panel, two(), "k", "t", ys).collect()}
    for r in paths.collect():
        x, w = np.array(r.path).reshape(chains, 2), want[r.k, r.t]
        cov = np.array(w.cov).reshape(2, 2)
        assert np.allclose(x.mean(axis=0), w.mean, atol=4 * np.sqrt(np.diag(cov).max() / chains)) and np.allclose(np.cov(x.T), cov, atol=0.25 * np.diag(cov).max())


def test_paths_of_counts_have_the_moments_of_the_grid(spark):
    rows, chains, x = series("poisson", 6, seed=2), 600, np.linspace(-6, 7, 1500)
    panel, e = frame(spark, {0: rows}, ["y"]), Emissions(["poisson"])
    paths = panel
    for n in range(6):
        paths = gibbs.swept(paths, repeated(one(), chains), e, "k", "t", ["y"], 12, [5, n])
    got = np.array([r.path for r in paths.orderBy("pos").collect()])
    steps = [linear.discretize(one().a, one().q, one().c, dt) for dt, _ in rows]
    kernels = [np.exp(-0.5 * (x[:, None] - ad[0, 0, 0] * x[None] - cd[0, 0]) ** 2 / qd[0, 0, 0]) for (ad, qd, cd), (dt, _) in zip(steps[1:], rows[1:])]
    ahead = [np.exp(-0.5 * (x - 0.5) ** 2 / 1.2) * np.exp(scores("poisson", rows[0][1], x + 0.1)[0])]
    for kernel, (_, y) in zip(kernels, rows[1:]):
        ahead.append((kernel @ ahead[-1]) * np.exp(scores("poisson", y, x + 0.1)[0]))
        ahead[-1] /= ahead[-1].sum()
    back = [np.ones_like(x)]
    for kernel, (_, y) in zip(reversed(kernels), reversed(rows[1:])):
        back.append(kernel.T @ (back[-1] * np.exp(scores("poisson", y, x + 0.1)[0])))
        back[-1] /= back[-1].sum()
    for i, (a, b) in enumerate(zip(ahead, reversed(back))):
        p = a * b / (a * b).sum()
        mean = p @ x
        sd = np.sqrt(p @ (x - mean) ** 2)
        assert got[i].mean() == pytest.approx(mean, abs=4 * sd / np.sqrt(chains)) and got[i].std() == pytest.approx(sd, rel=0.15)


def test_density_given_paths_and_its_slopes(spark):
    rng = np.random.default_rng(4)
    groups = {k: [(float(rng.choice([0.0, 0.5, 1.3])) if i else 0.0, np.array([*np.where(rng.random(2) < 0.3, np.nan, rng.normal(0.3, 1, 2)), float(rng.poisson(2))])) for i in range(7)] for k in range(3)}
    ys, e, chains = ["a", "b", "c"], Emissions(["gaussian", "gaussian", "poisson"]), 2
    panel = frame(spark, groups, ys)
    s = repeated(three(), chains)
    s.c[1] += 0.2
    paths = gibbs.swept(panel, s, e, "k", "t", ys, 10, [1]).cache()
    rows = gibbs.given_paths(paths, s, e, chains, "k", ys).toPandas()
    value = rows[rows.entry == 0].set_index("system").value
    for c in range(chains):
        want, before = 0.0, None
        for r in paths.orderBy("k", "pos").collect():
            x = np.array(r.path).reshape(chains, 3)[c]
            if r.pos == 1:
                gap, cov = x - s.m0[c], s.p0[c]
            elif r.dt > 0:
                ad, qd, cd = (v[0] for v in linear.discretize(s.a[c : c + 1], s.q[c : c + 1], s.c[c : c + 1], r.dt))
                gap, cov = x - ad @ before - cd, qd
            else:
                assert np.allclose(x, before)
                gap, cov = np.zeros(0), np.zeros((0, 0))
            want += -0.5 * (gap @ np.linalg.solve(cov, gap) + np.linalg.slogdet(cov)[1] + len(gap) * np.log(2 * np.pi)) if len(gap) else 0
            eta = s.h[c] @ x + s.d[c]
            want += sum(float(scores(f, v, np.array(eta[j]), sd=np.sqrt(s.r[c, j, j]))[0]) for j, (f, v) in enumerate(zip(e.families, (r.a, r.b, r.c))) if v is not None)
            before = x
        assert value[c] == pytest.approx(want, abs=1e-8)
    eps, names = 1e-5, [(f, i) for f in slopes.FIELDS for i in np.ndindex(getattr(s, f)[0].shape)]
    for entry, (f, i) in enumerate(names, 1):
        if f == "r" and 2 in i:
            continue  # a count has no noise of its own
        move = np.zeros_like(getattr(s, f)[0])
        move[i] = 1
        move = (move + move.T) / 2 if f in ("q", "r", "p0") else move
        if entry % 5 and f not in ("c", "m0", "d"):
            continue
        f2 = []
        for sign in (1, -1):
            other = System(**{g: getattr(s, g) + (sign * eps * move if g == f else 0) for g in slopes.FIELDS})
            made = gibbs.Given(other, e, chains)
            back = paths.orderBy("k", "pos").toPandas()
            x = np.stack(back.path.tolist()).reshape(len(back), chains, 3)
            made.add(x, np.concatenate([x[:1], x[:-1]]), back.dt.to_numpy(float), back.pos.to_numpy() == 1, back[ys].to_numpy(float))
            f2.append(made.total.copy())
        got = rows[rows.entry == entry].set_index("system").value.sort_index().to_numpy()
        assert np.allclose(got, (f2[0] - f2[1]) / (2 * eps), atol=1e-3 * (1 + np.abs(got))), (f, i)


def test_posterior_is_found_again(spark):
    truth = statespace.System.one(a=[[-0.5]], q=[[0.36]], c=[0.8], h=[[1]], d=[0], r=[[0.16]], m0=[0], p0=[[1]])
    made = statespace.simulate(spark, truth, 20, 25, 0.5, seed=3).withColumnRenamed("y0", "y")
    target = inference.Target(gibbs.cut(statespace.sort_panel(made, "series", "t")), inference.one_latent(), "series", "t", ["y"])
    centre, curve = inference.mode(target)
    sd = np.sqrt(np.diag(np.linalg.inv(curve)))
    got = gibbs.pgas(target, chains=6, particles=12, rounds=24, moves=2, leaps=4, seed=1).toPandas()
    natural = target.model.natural(centre[None])[0]
    slope = np.abs(target.model.natural((centre + 1e-4)[None])[0] - natural) / 1e-4
    for j, name in enumerate(target.model.names):
        own = got.value[got.param == name]
        assert abs(own.mean() - natural[j]) < 1.5 * sd[j] * slope[j] and 0.2 * sd[j] * slope[j] < own.std() < 3 * sd[j] * slope[j]
