"""Many series side by side against one row after another."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions.families import Emissions
from tideline.operators import lockstep, mixed, slopes, statespace
from tideline.operators.statespace import System

YS = ["a", "b", "c"]


def batch(size=3, n=2, seed=0):
    r = np.random.default_rng(seed)
    each = lambda *shape: r.normal(0, 0.3, (size, *shape))
    sq = lambda x: x @ np.swapaxes(x, -1, -2) + 0.2 * np.eye(x.shape[-1])
    return System(a=each(n, n) - np.eye(n), q=sq(each(n, n)), c=each(n), h=each(3, n) + 0.5, d=each(3), r=(0.3 + each(3) ** 2)[:, :, None] * np.eye(3), m0=each(n), p0=sq(each(n, n)))


def rows(seed=1):
    """Series of 1 to 40 rows, with missing values, equal times and irregular steps."""
    r, made = np.random.default_rng(seed), []
    for k, n in enumerate([5, 1, 40, 3, 3, 17, 1, 8]):
        t = np.cumsum(r.choice([0.0, 1.0, 1.0, 2.5], n) + (r.random(n) if k == 5 else 0))
        y = np.where(r.random((n, 3)) < 0.4, np.nan, r.normal(0.5, 1, (n, 3)))
        made.append(pd.DataFrame({"k": k, "t": t, **{c: y[:, j] for j, c in enumerate(YS)}}))
    return pd.concat(made, ignore_index=True)


def frames(df, size):
    return (df.iloc[i : i + size] for i in range(0, len(df), size))


def one_by_one(s, df):
    """(series, system) log-likelihoods by the row-wise steps."""
    out = {}
    for k, own in df.groupby("k"):
        m, p, total, before = s.m0, s.p0, np.zeros(s.size), None
        for t, y in zip(own.t, own[YS].to_numpy()):
            if before is not None and t > before:
                m, p = statespace.predict(s.steps()(t - before), m, p)
            m, p, ll = statespace.update(s, m, p, y)
            total, before = total + ll, t
        out |= {(k, i): v for i, v in enumerate(total)}
    return out


@pytest.mark.parametrize("n", [1, 2])
@pytest.mark.parametrize(("take", "frame"), [(4, 3), (11, 100), (1000, 7)])
def test_likelihoods_side_by_side(n, take, frame, monkeypatch):
    """Whatever is taken at once, and wherever that cuts a series."""
    monkeypatch.setattr(lockstep, "rows_at_once", lambda _: take)
    s, df = batch(n=n), rows()
    got = pd.concat(statespace._loglik(SimpleNamespace(value=s), "k", "t", YS)(frames(df, frame)))
    want = one_by_one(s, df)
    assert len(got) == len(want) and all(abs(want[r.k, r.system] - r.loglik) < 1e-9 for r in got.itertuples())
    assert got.groupby("k").n.first().to_dict() == df.groupby("k").size().to_dict()


@pytest.mark.parametrize(("take", "frame", "block"), [(4, 3, 4), (11, 100, 256), (1000, 7, 6)])
def test_no_series_is_cut_where_whole_ones_are_asked_for(take, frame, block):
    df = rows()
    got = list(lockstep.chunks(frames(df, frame), "k", "t", YS, take, whole=True))
    assert sorted((k, n) for c in got for k, n in zip(c.keys, c.sizes)) == sorted(df.groupby("k").size().items())
    assert all(len(c.y) <= take or len(c.keys) == 1 for c in got)
    assert np.array_equal(np.concatenate([c.time for c in got]), df.t.to_numpy())


@pytest.mark.parametrize("n", [1, 2])
@pytest.mark.parametrize("block", [4, 256])
def test_slopes_side_by_side(n, block, monkeypatch):
    monkeypatch.setattr(lockstep, "BLOCK", block)
    monkeypatch.setattr(lockstep, "rows_at_once", lambda _: 30)
    s, df = batch(n=n), rows()
    panel = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), mapInPandas=None)

    def of(apart):
        made = []
        panel.mapInPandas = lambda run, _: made.append(run) or SimpleNamespace(groupBy=lambda *_: SimpleNamespace(agg=lambda _: None))
        slopes.F, kept = SimpleNamespace(sum=lambda _: SimpleNamespace(alias=lambda _: None)), slopes.F
        try:
            slopes.value_and_slopes(panel, s, "k", "t", YS, apart=apart)
        finally:
            slopes.F = kept
        return pd.concat(made[0](frames(df, 13))).value.to_numpy().reshape(s.size, -1)

    got, want = of(True), of(False)
    at = 1 + sum(getattr(s, f)[0].size for f in ("a", "q", "c", "h", "d"))
    shared = at + np.flatnonzero(~np.eye(3, dtype=bool).ravel())
    assert (got[:, shared] == 0).all()
    got, want = np.delete(got, shared, axis=1), np.delete(want, shared, axis=1)
    assert np.allclose(got, want, rtol=1e-7, atol=1e-7), np.abs(got - want).max()


def test_a_packed_panel_is_the_panel(spark, monkeypatch):
    df = rows()
    panel = statespace.sort_panel(spark.createDataFrame(df), "k", "t")
    of = lambda p: {r.system: r.loglik for r in statespace.total_loglik(p, batch(), "k", "t", YS).groupBy("system").agg(F.sum("loglik").alias("loglik")).collect()}
    packed = lockstep.packed(panel, "k", "t", YS)
    assert packed.count() <= 4
    assert of(packed) == pytest.approx(of(panel))
    assert of(panel)[0] == pytest.approx(sum(v for (_, i), v in one_by_one(batch(), df).items() if i == 0))
    assert lockstep.packed(panel.where("k > 100"), "k", "t", YS).count() == 0


HOWS = [
    (["gaussian", "poisson", "neg_binomial"], mixed.Settings()),
    (["poisson", "gaussian", "bernoulli"], mixed.Settings(particles=7, exact=True)),
    (["gaussian", "poisson", "gamma"], mixed.Settings(particles=9, sampled=[1], df=[None, 4.0], points=5)),
    (["student_t", "poisson", "beta"], mixed.Settings(particles=5, sampled=[0, 1], points=1)),
]


@pytest.mark.parametrize(("families", "how"), HOWS)
@pytest.mark.parametrize("points", [200, 1 << 20])
def test_mixed_filters_side_by_side(families, how, points, monkeypatch):
    """The same numbers, drawn ones included, as one series after another, one row at a time."""
    monkeypatch.setattr(mixed, "POINTS", points)
    s, df = batch(), rows()
    for j, family in enumerate(families):
        own = df[YS[j]].to_numpy()
        made = {"bernoulli": own > 0.5, "beta": 1 / (1 + np.exp(-own)), "gaussian": own, "student_t": own, "gamma": np.exp(own)}.get(family, np.floor(np.abs(2 * own)))
        df[YS[j]] = np.where(np.isnan(own), np.nan, made)
    e = Emissions(families, {"r": np.array([[3.0], [4.0], [9.0]]) * np.ones(3)} if "neg_binomial" in families else {})
    got = pd.concat(mixed._walk(SimpleNamespace(value=(s, e, how)), mixed.Mixed, how, s.size, "k", "t", YS)(frames(df, 9)))
    assert len(got) == 3 * df.k.nunique()
    for k, own in df.groupby("k"):
        f = mixed.Mixed(s, e, how)
        f.start(k)
        for dt, y in zip(own.t.diff().fillna(0), own[YS].to_numpy()):
            if dt > 0:
                f.move(dt)
            f.see(y)
        assert np.allclose(got[got.k == k].sort_values("system").loglik, f.total, rtol=1e-9, atol=1e-9)


def test_noise_in_common_is_not_taken_side_by_side():
    s = batch()
    s.r = s.r + 0.05
    assert not lockstep.Filter.serves(s)
