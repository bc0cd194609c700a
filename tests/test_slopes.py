"""Slopes of the Kalman likelihood against differences."""

import numpy as np
import pytest

from tests.test_mixed import two
from tideline.operators import inference, slopes, statespace
from tideline.operators.statespace import System


def panel(spark, n=3, rows=9, seed=0):
    rng = np.random.default_rng(seed)
    made = [(k, float(t), *(None if rng.random() < 0.2 else float(v) for v in rng.normal(0.5, 1, 3))) for k in range(n) for t in np.cumsum(rng.choice([0.0, 0.5, 1.3], rows))]
    return statespace.sort_panel(spark.createDataFrame(made, "k long, t double, a double, b double, c double"), "k", "t")


YS = ["a", "b", "c"]


@pytest.mark.parametrize("block", [2, 256])
def test_slopes_of_every_entry(spark, block, monkeypatch):
    """Entries of covariances move in pairs, as they do in a symmetric matrix."""
    monkeypatch.setattr(slopes, "BLOCK", block)
    p, s, eps = panel(spark).cache(), two(), 1e-5
    shifted, meant = [], []
    for f in slopes.FIELDS:
        v = getattr(s, f)[0]
        for i in np.ndindex(v.shape):
            move = np.zeros_like(v)
            move[i] += 1
            if f in ("q", "r", "p0"):
                move = (move + move.T) / 2
            for sign in (1, -1):
                shifted.append({g: getattr(s, g)[0] + (sign * eps * move if g == f else 0) for g in slopes.FIELDS})
            meant.append((f, i))
    batch = System(*[np.stack([x[f] for x in shifted]) for f in slopes.FIELDS])
    lls = statespace.loglik(p, batch, "k", "t", YS).groupBy("system").sum("loglik").toPandas().set_index("system")["sum(loglik)"].sort_index().to_numpy()
    want = (lls[::2] - lls[1::2]) / (2 * eps)
    value, *got = [r.value for r in slopes.value_and_slopes(p, s, "k", "t", YS).orderBy("entry").collect()]
    assert value == pytest.approx(statespace.loglik(p, s, "k", "t", YS).groupBy().sum("loglik").first()[0], abs=1e-9)
    assert np.allclose(got, want, atol=1e-4 * (1 + np.abs(want))), [(m, g, w) for m, g, w in zip(meant, got, want) if abs(g - w) > 1e-4 * (1 + abs(w))]


def test_slopes_in_parameters(spark):
    p = panel(spark, seed=3).cache()
    model = inference.structural(["A", "B"], [("A", "B"), ("B", "A")], YS, {("a", "A"): 1.0, ("b", "A"): None, ("b", "B"): None, ("c", "B"): 1.0}, means=("b",))
    target = inference.Target(p, model, "k", "t", YS)
    theta = model.mean + 0.3 * model.sd * np.random.default_rng(1).standard_normal((2, len(model.names)))
    value, slope = target.value_and_slope(theta)
    eye = np.eye(len(model.names)) * 1e-5
    for b in range(2):
        want = (target(theta[b] + eye) - target(theta[b] - eye)) / 2e-5
        assert np.allclose(slope[b], want, atol=1e-4 * (1 + np.abs(want)))
    assert np.allclose(value, target(theta))
