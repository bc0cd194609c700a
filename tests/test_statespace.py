import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import linear, sampling
from tideline.operators import inference, mixed, statespace
from tideline.plans import states
from tideline.plans.states import one, two


def joint(s, rows):
    """Mean and covariance of all states of one series, the map from them to all observations, its offset and noise."""
    a, q, c = s.a[0], s.q[0], s.c[0]
    n, means, covs, steps = a.shape[0], [s.m0[0]], [s.p0[0]], []
    for (t0, _), (t1, _) in zip(rows, rows[1:]):
        ad, qd, cd = (x[0] for x in linear.discretize(s.a, s.q, s.c, t1 - t0))
        steps.append(ad)
        means.append(ad @ means[-1] + cd)
        covs.append(ad @ covs[-1] @ ad.T + qd)
    k = len(rows)
    big = np.zeros((k * n, k * n))
    for i in range(k):
        cross = covs[i]
        big[i * n : (i + 1) * n, i * n : (i + 1) * n] = cross
        for j in range(i + 1, k):
            cross = steps[j - 1] @ cross
            big[j * n : (j + 1) * n, i * n : (i + 1) * n] = cross
            big[i * n : (i + 1) * n, j * n : (j + 1) * n] = cross.T
    return np.concatenate(means), big, np.kron(np.eye(k), s.h[0]), np.tile(s.d[0], k), np.kron(np.eye(k), s.r[0])


def brute(s, rows):
    """Log-likelihood of one series as a single normal distribution over all its observations."""
    mean, big, h, d, r = joint(s, rows)
    mu, cov = h @ mean + d, h @ big @ h.T + r
    y = np.concatenate([x[1] for x in rows])
    seen = np.isfinite(y)
    v, cov = (y - mu)[seen], cov[np.ix_(seen, seen)]
    return -0.5 * (seen.sum() * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + v @ np.linalg.solve(cov, v))


ROWS = [(0.0, [1.0, 2.0]), (0.5, [float("nan"), 1.0]), (2.0, [0.2, float("nan")]), (2.25, [float("nan")] * 2), (4.0, [1.5, 0.1])]


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(k, t, *[None if v != v else v + k for v in y]) for k in range(3) for t, y in ROWS]
    return statespace.sort_panel(spark.createDataFrame(rows, "series long, t double, y0 double, y1 double"), "series", "t")


def test_loglik_is_that_of_the_joint_normal(panel):
    got = {r.series: r.loglik for r in statespace.loglik(panel, two(), "series", "t", ["y0", "y1"]).collect()}
    for k in range(3):
        assert got[k] == pytest.approx(brute(two(), [(t, np.array(y) + k) for t, y in ROWS]), abs=1e-8)


def test_smoother_ends_where_the_filter_ends_and_is_tighter(panel):
    f = {(r.series, r.t): r for r in statespace.filtered(panel, two(), "series", "t", ["y0", "y1"]).collect()}
    s = {(r.series, r.t): r for r in statespace.smoothed(panel, two(), "series", "t", ["y0", "y1"]).collect()}
    assert f.keys() == s.keys()
    assert s[0, 4.0].mean == pytest.approx(f[0, 4.0].mean)
    assert all(s[k].cov[0] <= f[k].cov[0] + 1e-12 for k in s)


def test_smoother_is_the_states_given_all_observations(panel):
    got = statespace.smoothed(panel, two(), "series", "t", ["y0", "y1"]).where("series = 1").orderBy("t").collect()
    rows = [(t, np.array(y) + 1) for t, y in ROWS]
    mean, big, h, d, r = joint(two(), rows)
    y = np.concatenate([x[1] for x in rows])
    seen = np.isfinite(y)
    h, d, r = h[seen], d[seen], r[np.ix_(seen, seen)]
    gain = big @ h.T @ np.linalg.inv(h @ big @ h.T + r)
    want, cov = mean + gain @ (y[seen] - h @ mean - d), big - gain @ h @ big
    for i, row in enumerate(got):
        assert np.allclose(row.mean, want[2 * i : 2 * i + 2], atol=1e-8)
        assert np.allclose(np.reshape(row.cov, (2, 2)), cov[2 * i : 2 * i + 2, 2 * i : 2 * i + 2], atol=1e-8)


def test_linear_identities():
    a, q, c = two().a, two().q, two().c
    x = linear.lyapunov(a, q)
    assert np.allclose(a @ x + x @ np.swapaxes(a, -1, -2) + q, 0)
    assert np.allclose(linear.lyapunov(-np.eye(2)[None], np.eye(2)[None]), 0.5 * np.eye(2))
    e = linear.expm(np.array([[[0.0, -np.pi], [np.pi, 0.0]]]))
    assert np.allclose(e[0], -np.eye(2))
    assert linear.effect(np.array([[-1, 0.5], [0, -1.0]]), np.ones(2), 1, 0) == pytest.approx(0.5)
    far = linear.discretize(a, q, c, 200.0)
    assert np.allclose(far[0], 0, atol=1e-8) and np.allclose(far[1], x) and np.allclose(far[2], linear.steady(a, c))


def test_particle_filter_is_near_the_kalman_filter(spark):
    p = statespace.sort_panel(states.panel(spark, "/root/testdata/sf0.001").where("user_id <= 5"), "user_id", "t")
    exact = {r.user_id: r.loglik for r in statespace.loglik(p, one(), "user_id", "t", ["y"]).collect()}
    near = {r.user_id: r.loglik for r in mixed.particle_loglik(p, one(), ["gaussian"], "user_id", "t", ["y"], 3000).collect()}
    assert exact.keys() == near.keys()
    assert all(abs(exact[k] - near[k]) < 0.5 for k in exact)


def test_empty_panel(spark, panel):
    none = panel.where("false")
    assert statespace.loglik(none, two(), "series", "t", ["y0", "y1"]).count() == 0
    assert statespace.smoothed(none, two(), "series", "t", ["y0", "y1"]).count() == 0


def test_fits_recover_the_parameters(spark):
    truth = statespace.System.one(a=[[-0.5]], q=[[0.36]], c=[0.8], h=[[1]], d=[0], r=[[0.16]], m0=[0], p0=[[1]])
    made = statespace.simulate(spark, truth, 30, 60, 0.5, seed=3).withColumnRenamed("y0", "y")
    held = statespace.sort_panel(made, "series", "t").cache()
    target = inference.Target(held, inference.one_latent(), "series", "t", ["y"])
    want = {"drift": -0.5, "diffusion_sd": 0.6, "cint": 0.8, "measurement_sd": 0.4}
    for method, how in (("laplace", {}), ("tempered_smc", {"particles": 64, "moves": 4}), ("hmc", {"chains": 8, "steps": 15})):
        got = inference.fit(target, method, **how).groupBy("param").avg("value").collect()
        assert {r.param: r["avg(value)"] for r in got} == pytest.approx(want, abs=0.15), method
    profiles = inference.profile(target, points=21)
    top = profiles.groupBy("param").agg(F.max("log_post").alias("top")).collect()
    assert max(r.top for r in top) - min(r.top for r in top) < 2 and len(top) == 4
    assert {r.verdict for r in inference.identified(profiles).collect()} == {"identified"}
    held.unpersist()


def test_structural_systems_have_their_entries_in_place():
    model = inference.structural(
        ["A", "B", "T"], [("A", "B"), ("T", "A")], ["x", "y", "z"], {("x", "A"): 1.0, ("y", "B"): None, ("z", "T"): 2.0}, still=("T",), means=("z",),
        priors={"effect_B_A": (0.3, 0.1)}
    )
    assert model.names == ["drift_A", "drift_B", "effect_B_A", "effect_A_T", "diffusion_A", "diffusion_B", "cint_A", "cint_B", "loading_y_B", "mean_z", "noise_x", "noise_y", "noise_z"]
    assert model.mean[2] == 0.3 and model.sd[2] == 0.1
    t = np.linspace(-0.6, 0.6, 13)[None]
    s, n = model.build(t), dict(zip(model.names, model.natural(t)[0]))
    assert np.allclose(s.a[0], [[n["drift_A"], 0, n["effect_A_T"]], [n["effect_B_A"], n["drift_B"], 0], [0, 0, -inference.STILL]]) and n["drift_A"] < 0
    assert np.allclose(np.diag(s.q[0]), [n["diffusion_A"] ** 2, n["diffusion_B"] ** 2, inference.STILL**2])
    assert np.allclose(s.h[0], [[1, 0, 0], [0, n["loading_y_B"], 0], [0, 0, 2]]) and np.allclose(s.d[0], [0, 0, n["mean_z"]]) and np.allclose(s.c[0], [n["cint_A"], n["cint_B"], 0])
    away = np.zeros((1, 13))
    away[0, 3], settled = 5.0, model.log_prior(np.zeros((1, 13)))[0]
    assert model.log_prior(away)[0] < settled and np.isfinite(model.log_prior(np.full((1, 13), 1e6))[0])


def test_profiles_tell_what_cannot_be_told(spark):
    """Two loadings and a drift of a variable that nothing measures: only its prior shapes them."""
    truth = statespace.System.one(a=[[-0.5]], q=[[0.36]], c=[0.8], h=[[1]], d=[0], r=[[0.16]], m0=[0], p0=[[1]])
    made = statespace.sort_panel(statespace.simulate(spark, truth, 10, 40, 0.5, seed=5), "series", "t").cache()
    wide = {"drift_B": (-0.7, 50.0), "cint_B": (0.0, 50.0)}
    model = inference.structural(["A", "B"], [], ["y0"], {("y0", "A"): 1.0}, priors=wide)
    got = {r.param: r.verdict for r in inference.identified(inference.profile(inference.Target(made, model, "series", "t", ["y0"]), ["drift_A", "cint_B"], points=10, reach=0.5)).collect()}
    assert got["cint_B"] == "structurally_unidentifiable"
    made.unpersist()


def test_replicates_have_the_moments_of_their_families(spark):
    """A state at rest: every channel's predictor is the same at all times. Then a moving one, against the closed form."""
    families = list(sampling.FAMILIES)
    loc = 0.7
    rest = [(k, [-1.0], [0.0], [1.0] * 7, [loc], [0.0] * 7, [0.5] * 7, [loc], [0.0]) for k in range(1500)]
    schema = "draw bigint, " + ", ".join(f"{c} array<double>" for c in statespace.PARAMETERS)
    got = statespace.predictive(spark.createDataFrame(rest, schema), [0.0, 1.0, 1.0, 2.5], families, families).groupBy("variable").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v")).collect()
    mean, share = np.exp(loc), 1 / (1 + np.exp(-loc))
    want = {
        "gaussian": (loc, 0.25), "student_t": (loc, 0.25 * 5 / 3), "poisson": (mean, mean), "gamma": (mean, mean**2 / 2), "bernoulli": (share, share * (1 - share)),
        "neg_binomial": (mean, mean + mean**2 / 5), "beta": (share, share * (1 - share) / 11),
    }
    assert len(got) == 7
    for r in got:
        assert r.m == pytest.approx(want[r.variable][0], rel=0.05) and r.v == pytest.approx(want[r.variable][1], rel=0.15), r.variable
    moving = [(k, [-0.5], [0.8], [2.0], [0.3], [1.0], [0.1], [0.0], [1.0]) for k in range(4000)]
    df = spark.createDataFrame(moving, schema)
    rows = {r.t: r for r in statespace.predictive(df, [0.0, 3.0], ["y"], ["gaussian"]).groupBy("t").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v")).collect()}
    step = np.exp(-1.5)
    assert rows[0.0].m == pytest.approx(1.0, abs=0.12) and rows[0.0].v == pytest.approx(4.01, rel=0.1)
    assert rows[3.0].m == pytest.approx(1 + 2 * 0.6 * (1 - step), abs=0.1) and rows[3.0].v == pytest.approx(4 * (step**2 + 0.64 * (1 - step**2)) + 0.01, rel=0.1)
    again = [statespace.predictive(df.limit(5), [0.0, 3.0], ["y"], ["gaussian"]).orderBy("draw", "t").collect() for _ in range(2)]
    assert again[0] == again[1]
