"""States at their mode against a dense optimiser, and Laplace's likelihood against its definition."""

import numpy as np
import pytest

from tests.test_mixed import grid_loglik, one, series, three, two
from tideline.functions import families, linear
from tideline.functions.families import Emissions
from tideline.operators import modes, statespace
from tideline.operators.statespace import System


def frame(spark, groups, ys):
    """Rows (k, t, ys) of series given as [(dt, observations)]."""
    rows = [(k, float(t), *(None if not np.isfinite(v) else float(v) for v in np.atleast_1d(y))) for k, g in groups.items() for t, y in zip(np.cumsum([r[0] for r in g]), [r[1] for r in g])]
    return statespace.sort_panel(spark.createDataFrame(rows, "k long, t double, " + ", ".join(f"{y} double" for y in ys)), "k", "t")


def dense(s: System, e: Emissions, rows):
    """(mode of all states, Laplace's log-likelihood) by Newton's method on one long vector, with halved steps."""
    n, t = s.a.shape[-1], len(rows)
    # the normal prior of all states together
    mean, cov = np.zeros((t, n)), np.zeros((t, n, t, n))
    mean[0], cov[0, :, 0] = s.m0[0], s.p0[0]
    for i in range(1, t):
        dt = rows[i][0]
        ad, qd, cd = (v[0] for v in linear.discretize(s.a, s.q, s.c, dt)) if dt > 0 else (np.eye(n), np.zeros((n, n)) + 1e-11 * np.eye(n), np.zeros(n))
        mean[i] = ad @ mean[i - 1] + cd
        for j in range(i):
            cov[i, :, j] = ad @ cov[i - 1, :, j]
            cov[j, :, i] = cov[i, :, j].T
        cov[i, :, i] = ad @ cov[i - 1, :, i - 1] @ ad.T + qd
    mean, cov = mean.ravel(), cov.reshape(t * n, t * n)
    inv = np.linalg.inv(cov)
    h = np.kron(np.eye(t), s.h[0])
    y, sd = np.concatenate([np.atleast_1d(r[1]) for r in rows]), np.sqrt(np.diag(s.r[0]))
    seen = np.flatnonzero(np.isfinite(y))
    m = len(e.families)

    def parts(x):
        eta = h @ x + np.tile(s.d[0], t)
        got = [e.scores(int(i % m), float(y[i]), eta[i : i + 1], sd[i % m : i % m + 1]) for i in seen]
        dens = sum(float(g[0][0]) for g in got) - 0.5 * (x - mean) @ inv @ (x - mean)
        g, w = np.zeros(len(y)), np.zeros(len(y))
        g[seen], w[seen] = [v[1][0] for v in got], [v[2][0] for v in got]
        return dens, h.T @ g - inv @ (x - mean), inv + h.T @ (w[:, None] * h)

    x = mean.copy()
    for _ in range(200):
        f, g, hess = parts(x)
        step = np.linalg.solve(hess + max(0.0, 1e-6 - np.linalg.eigvalsh(hess)[0]) * np.eye(len(x)), g)
        a = 1.0
        while parts(x + a * step)[0] < f and a > 1e-8:
            a /= 2
        x = x + a * step
        if np.abs(step).max() < 1e-12:
            break
    f, _, hess = parts(x)
    return x.reshape(t, n), f - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.linalg.slogdet(hess)[1]


@pytest.mark.parametrize("family", [f for f in families.FAMILIES if f != "student_t"])
def test_mode_and_likelihood_equal_a_dense_optimiser(spark, family):
    groups = {k: series(family, 9, seed=k) for k in range(3)}
    groups[1][4] = (groups[1][4][0], np.nan)
    panel, e = frame(spark, groups, ["y"]), Emissions([family])
    got = modes.smoothed(panel, one(), e, "k", "t", ["y"]).orderBy("k", "pos").collect()
    ll = {r.k: r.loglik for r in modes.laplace_loglik(panel, one(), e, "k", "t", ["y"]).collect()}
    for k, g in groups.items():
        mode, want = dense(one(), e, g)
        assert np.allclose([r.mean[0] for r in got if r.k == k], mode[:, 0], atol=1e-6)
        assert ll[k] == pytest.approx(want, abs=1e-6)
    assert max(r.step for r in got) < 1e-6


def test_normal_channels_give_kalman(spark):
    rng = np.random.default_rng(1)
    groups = {k: [(float(rng.choice([0.5, 1.3])) if i else 0.0, np.where(rng.random(3) < 0.2, np.nan, rng.normal(0.5, 1, 3))) for i in range(10)] for k in range(4)}
    groups[2][5] = (0.0, groups[2][5][1])
    panel, ys = frame(spark, groups, ["a", "b", "c"]), ["a", "b", "c"]
    e = Emissions(["gaussian"] * 3)
    of = lambda df: {r.k: r.loglik for r in df.collect()}
    got, want = of(modes.laplace_loglik(panel, two(), e, "k", "t", ys)), of(statespace.loglik(panel, two(), "k", "t", ys))
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
    states = {(r.k, r.t): r for r in statespace.smoothed(panel.where("k <> 2"), two(), "k", "t", ys).collect()}
    for r in modes.smoothed(panel.where("k <> 2"), two(), e, "k", "t", ys).collect():
        assert np.allclose(r.mean, states[r.k, r.t].mean, atol=1e-7) and np.allclose(r.cov, states[r.k, r.t].cov, atol=1e-7)


def test_several_families_and_systems(spark):
    rng = np.random.default_rng(5)
    groups = {k: [(0.7 if i else 0.0, np.array([*rng.normal(0.3, 1, 2), float(rng.poisson(2))])) for i in range(7)] for k in range(2)}
    ys, e = ["a", "b", "c"], Emissions(["gaussian", "student_t", "poisson"], {"df": [[8.0] * 3]})
    panel = frame(spark, groups, ys)
    fields = ("a", "q", "c", "h", "d", "r", "m0", "p0")
    other = System(**{f: getattr(three(), f).copy() for f in fields})
    other.c[0, 2] = 0.8
    both = System(*[np.concatenate([getattr(three(), f), getattr(other, f)]) for f in fields])
    got = {(r.k, r.system): r.loglik for r in modes.laplace_loglik(panel, both, e, "k", "t", ys, rounds=40).collect()}
    for k, g in groups.items():
        for b, s in enumerate((three(), other)):
            assert got[k, b] == pytest.approx(dense(s, e, g)[1], abs=1e-5)


def test_far_starts_and_no_rows(spark):
    groups = {0: [(0.0, 400.0), (1.0, 0.0), (1.0, 0.0)], 1: [(0.0, np.nan), (1.0, np.nan)]}
    panel, e = frame(spark, groups, ["y"]), Emissions(["poisson"])
    got = modes.smoothed(panel, one(), e, "k", "t", ["y"], rounds=60).where("k = 0").orderBy("pos").collect()
    assert np.allclose([r.mean[0] for r in got], dense(one(), e, groups[0])[0][:, 0], atol=1e-6)
    assert modes.laplace_loglik(panel.where("k > 5"), one(), e, "k", "t", ["y"]).count() == 0
    unseen = modes.laplace_loglik(panel.where("k = 1"), one(), e, "k", "t", ["y"]).collect()
    assert [(r.n, r.loglik) for r in unseen] == [(2, 0.0)]


def test_bound_is_below_the_integral_and_grows(spark):
    for family in ("poisson", "bernoulli", "gamma"):
        groups = {k: series(family, 8, seed=k) for k in range(3)}
        panel, e = frame(spark, groups, ["y"]), Emissions([family])
        exact = {k: grid_loglik(family, g) for k, g in groups.items()}
        first, last = ({r.k: r.loglik for r in modes.bound_loglik(panel, one(), e, "k", "t", ["y"], n).collect()} for n in (1, 12))
        for k in groups:
            assert first[k] <= exact[k] + 1e-6 and first[k] - 1e-6 <= last[k] <= exact[k] + 1e-6
            assert last[k] > exact[k] - 0.1


def test_bound_is_exact_for_normal_channels(spark):
    rng = np.random.default_rng(2)
    groups = {k: [(0.8 if i else 0.0, np.where(rng.random(3) < 0.2, np.nan, rng.normal(0.5, 1, 3))) for i in range(6)] for k in range(3)}
    panel, ys = frame(spark, groups, ["a", "b", "c"]), ["a", "b", "c"]
    got = {r.k: r.loglik for r in modes.bound_loglik(panel, two(), Emissions(["gaussian"] * 3), "k", "t", ys, 1).collect()}
    want = {r.k: r.loglik for r in statespace.loglik(panel, two(), "k", "t", ys).collect()}
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
