"""Slopes of the Kalman likelihood in every entry of a system, by one walk forwards and one back through each series.

The walk back needs the states that the walk forward went through. States are kept at the first row of every BLOCK rows, and
those in between are computed again a block at a time; of a series' rows a task keeps times and observations. Where noise of
channels is apart and slopes in what it has in common are not asked for, many series go side by side (see `lockstep`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import linear
from tideline.operators import lockstep
from tideline.operators.statespace import System, predict, update, walk

FIELDS = ("a", "q", "c", "h", "d", "r", "m0", "p0")
BLOCK = 256

turned = lambda x: np.swapaxes(x, -1, -2)
outer = lambda x, y: x[..., :, None] * y[..., None, :]
times = lambda a, x: (a @ x[..., None])[..., 0]


def _updated_back(s: System, m: np.ndarray, p: np.ndarray, y: np.ndarray, gm: np.ndarray, gp: np.ndarray, to: dict) -> tuple[np.ndarray, np.ndarray]:
    """Slopes in the state before an observation, from those in the state after it; adds those in h, d and r. Only
    symmetric parts of slopes in covariances count."""
    seen = np.isfinite(y)
    if not seen.any():
        return gm, gp
    h = s.h[:, seen]
    v = y[seen] - times(h, m) - s.d[:, seen]
    ph = p @ turned(h)
    inv = np.linalg.inv(h @ ph + s.r[:, seen][:, :, seen])
    w, gain = times(inv, v), ph @ inv
    pull = times(turned(gain), gm)
    gs = -0.5 * (inv - outer(w, w)) - outer(pull, w) + turned(gain) @ gp @ gain
    gs = (gs + turned(gs)) / 2
    gv = pull - w
    gh = outer(w, times(p, gm)) - 2 * turned(gain) @ gp @ p + 2 * gs @ turned(ph) - outer(gv, m)
    out = gp - turned(gain @ h) @ gp - gp @ (gain @ h) + outer(gm, times(turned(h), w)) + turned(h) @ gs @ h
    at = np.flatnonzero(seen)
    to["h"][:, at] += gh
    to["d"][:, at] -= gv
    to["r"][:, at[:, None], at] += gs
    return gm - times(turned(h), gv), (out + turned(out)) / 2


def _discretised_back(s: System, dt: float | np.ndarray, ga: np.ndarray, gq: np.ndarray, gc: np.ndarray, to: dict) -> None:
    """Adds slopes in drift, noise and intercept from those in their forms over dt. Several intervals, as (intervals, 1, 1, 1),
    are the first axis of the slopes."""
    a = s.a
    summed = lambda x, like: x.reshape(-1, *like.shape).sum(axis=0)
    eye = np.eye(a.shape[-1])
    step, rest = linear.expm(a * dt), linear.lyapunov(a, s.q)
    shift = np.linalg.solve(a, times(step - eye, s.c)[..., None])[..., 0]
    gq = (gq + turned(gq)) / 2
    grest = gq - turned(step) @ gq @ step
    u = np.linalg.solve(turned(a), gc[..., None])[..., 0]
    gstep = ga - 2 * gq @ step @ rest + outer(u, s.c)
    y = linear.lyapunov(turned(a), grest)
    to["q"] += summed(y, to["q"])
    to["c"] += summed(times(turned(step - eye), u), to["c"])
    n = a.shape[-1]
    both = np.zeros((*gstep.shape[:-2], 2 * n, 2 * n))
    both[..., :n, :n] = both[..., n:, n:] = turned(a) * dt
    both[..., :n, n:] = gstep
    to["a"] += summed(2 * y @ rest - outer(u, shift) + dt * linear.expm(both)[..., :n, n:], to["a"])


class Series:
    """Rows of one series as they come, and then the slopes of its likelihood."""

    def __init__(self, s: System, at):
        self.s, self.at, self.rows, self.kept = s, at, [], []
        self.m, self.p, self.total = s.m0, s.p0, np.zeros(s.size)

    def add(self, dt: float, y: np.ndarray) -> None:
        if len(self.rows) % BLOCK == 0:
            self.kept.append((self.m, self.p))
        if dt > 0:
            self.m, self.p = predict(self.at(dt), self.m, self.p)
        self.m, self.p, ll = update(self.s, self.m, self.p, y)
        self.total = self.total + ll
        self.rows.append((dt, y))

    def back(self, to: dict, steps: dict) -> None:
        """Adds to the slopes in h, d, r, m0 and p0, and for each interval to those in its transition, noise and shift."""
        s = self.s
        gm, gp = np.zeros_like(s.m0), np.zeros_like(s.p0)
        for b in reversed(range(len(self.kept))):
            m, p = self.kept[b]
            block, states = self.rows[b * BLOCK : (b + 1) * BLOCK], []
            for dt, y in block:
                before = m, p
                if dt > 0:
                    m, p = predict(self.at(dt), m, p)
                states.append((*before, m, p))
                m, p, _ = update(s, m, p, y)
            for (dt, y), (m0, p0, m1, p1) in zip(reversed(block), reversed(states)):
                gm, gp = _updated_back(s, m1, p1, y, gm, gp, to)
                if dt > 0:
                    ad = self.at(dt)[0]
                    if dt not in steps:
                        steps[dt] = [np.zeros_like(s.a), np.zeros_like(s.q), np.zeros_like(s.c)]
                    ga, gq, gc = steps[dt]
                    ga += outer(gm, m0) + 2 * gp @ ad @ p0
                    gq += gp
                    gc += gm
                    gm, gp = times(turned(ad), gm), turned(ad) @ gp @ ad
        to["m0"] += gm
        to["p0"] += gp


def value_and_slopes(panel: DataFrame, system: System, key: str, time: str, ys: list[str], apart: bool = False) -> DataFrame:
    """(system, entry, value): the log-likelihood of all series of a sorted panel as entry 0, then its slopes in the entries of a,
    q, c, h, d, r, m0 and p0, row by row one after another. Each task adds up its series; what is shuffled does not grow
    with them. apart: slopes in noise that channels have in common are given as zero."""
    sent = panel.sparkSession.sparkContext.broadcast(system)

    def flat(s: System, total: np.ndarray, to: dict) -> pd.DataFrame:
        entries = np.concatenate([total[:, None], *[to[f].reshape(s.size, -1) for f in FIELDS]], axis=1)
        return pd.DataFrame({"system": np.repeat(np.arange(s.size), entries.shape[1]), "entry": np.tile(np.arange(entries.shape[1]), s.size), "value": entries.ravel()})

    def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, some = sent.value, False
        f, total, to = lockstep.Slopes(s), np.zeros(s.size), {x: np.zeros_like(getattr(s, x), float) for x in FIELDS}
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for chunk in lockstep.chunks(frames, key, time, ys, lockstep.rows_at_once(s.size), whole=True):
                some = True
                more, values, sums = f.both_ways(chunk)
                total += more
                moved = np.flatnonzero(values > 0)
                for part in np.array_split(moved, -(-len(moved) * s.size // lockstep.CELLS * 8) or 1):
                    if len(part):
                        _discretised_back(s, values[part][:, None, None, None], *[np.moveaxis(x[..., part], (-1, -2), (0, 1)) for x in sums], to)
        if some:
            for x, own in f.to.items():
                own = np.moveaxis(own, -1, 0)
                to[x] += own[:, :, None] * np.eye(own.shape[1]) if x == "r" else own
            yield flat(s, total, to)

    def one_by_one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sent.value
        to = {f: np.zeros_like(getattr(s, f), float) for f in FIELDS}
        at, steps, total, one = s.steps(), {}, np.zeros(s.size), None

        def close() -> None:
            one.back(to, steps)
            if len(steps) > BLOCK:
                settle()

        def settle() -> None:
            for dt, slopes in steps.items():
                _discretised_back(s, dt, *slopes, to)
            steps.clear()

        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for _, new, dt, _, y in walk(frames, key, time, ys):
                if new:
                    if one is not None:
                        close()
                        total = total + one.total
                    one = Series(s, at)
                one.add(dt, y)
            if one is None:
                return
            close()
            total = total + one.total
            settle()
        yield flat(s, total, to)

    run = together if apart and lockstep.Filter.serves(system) else one_by_one
    return panel.mapInPandas(run, "system int, entry int, value double").groupBy("system", "entry").agg(F.sum("value").alias("value"))


def chained(system: System, slopes: np.ndarray, build, theta: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Slopes in parameters, from those in the entries of the systems that `build` makes of them."""
    b, dim = theta.shape
    shifted = (theta[:, None] + np.concatenate([np.eye(dim), -np.eye(dim)]) * eps).reshape(-1, dim)
    made = build(shifted)
    flat = np.concatenate([np.broadcast_to(getattr(made, f), (len(shifted), *getattr(made, f).shape[1:])).reshape(len(shifted), -1) for f in FIELDS], axis=1).reshape(b, 2, dim, -1)
    return ((flat[:, 0] - flat[:, 1]) / (2 * eps) * slopes[:, None]).sum(axis=-1)
