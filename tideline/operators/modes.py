"""States at their most likely, for series with channels of any family, and Laplace's form of the likelihood.

Each round takes every channel that is not normal for a normal one: an observation that, with some noise, has the slope and
curvature of the log-density at the predictor as it is. Smoothing with these gives the next predictor, which is a Newton step on
all states of a series at once; where nothing moves any more it is their mode. A predictor goes at most TRUST at a time.

With slopes and curvatures averaged over the predictor's own spread in place of those at one point, the same rounds lead to the
normal guide that makes the bound on the evidence greatest: a density of all states that factors backwards over time. The
bound holds after any number of rounds.

A round is a filter forwards and a smoother backwards over rows that are already together: they are sorted the other way
within their partitions, and nothing is shuffled. Tasks hold one state of one series, however long it is; what a round leaves
is written down, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import families, quadrature
from tideline.functions.families import Emissions
from tideline.lineage import cut
from tideline.operators.mixed import root
from tideline.operators.statespace import System, predict

#: Largest change of a predictor in a round, the least curvature counted, and the change that ends the rounds.
TRUST, FLAT, STILL = 3.0, 1e-8, 1e-9
#: Points of the rule that averages over a predictor.
POINTS = 20
ROWS = 2_000


class Pseudo:
    """Normal observations in place of the channels at predictors eta (systems, channels), or averaged over normal ones with
    variances var."""

    def __init__(self, s: System, e: Emissions, averaged: bool = False):
        self.s, self.e, self.sd, self.averaged = s, e, np.sqrt(np.diagonal(s.r, axis1=-2, axis2=-1)), averaged

    def scores(self, j: int, y: float, eta: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, ...]:
        """Log-density, slope, curvature and information of channel j for each system."""
        if not self.averaged:
            return self.e.scores(j, y, eta, self.sd[:, j])
        u, w = quadrature.gauss_hermite(POINTS)
        got = self.e.scores(j, y, eta[:, None] + np.sqrt(np.maximum(var, 0))[:, None] * u, self.sd[:, j])
        return tuple((np.broadcast_to(g, (len(eta), POINTS)) * w).sum(axis=1) for g in got)

    def at(self, y: np.ndarray, eta: np.ndarray, var: np.ndarray, seen: np.ndarray, among: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value, noise, gain): of the seen channels, and what their density exceeds that of these observations by: at eta, or
        on average where the predictor has the mean and variance `among`."""
        z = np.broadcast_to(y[seen], (self.s.size, seen.sum())).copy()
        noise, gain = self.s.r[:, seen][:, :, seen].copy(), np.zeros(self.s.size)
        for i, j in enumerate(np.flatnonzero(seen)):
            if self.e.families[j] == "gaussian":
                continue
            own = eta[:, j]
            dens, slope, curve, info = self.scores(int(j), float(y[j]), own, var[:, j])
            w = np.maximum(np.where(curve > FLAT, curve, info), FLAT)
            z[:, i] = own + slope / w
            noise[:, i, :] = noise[:, :, i] = 0
            noise[:, i, i] = 1 / w
            apart = slope**2 / w
            if among is not None:
                mean, spread = among[0][:, j], among[1][:, j]
                dens, apart = self.scores(int(j), float(y[j]), mean, spread)[0], w * ((z[:, i] - mean) ** 2 + spread)
            gain += dens + 0.5 * (apart + log(2 * pi) - np.log(w))
        return z, noise, gain

    def predictor(self, m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of each channel's predictor."""
        return (self.s.h @ m[..., None])[..., 0] + self.s.d, np.einsum("bij,bjk,bik->bi", self.s.h, p, self.s.h)

    def conditioned(self, m: np.ndarray, p: np.ndarray, y: np.ndarray, eta: np.ndarray, var: np.ndarray, among: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State after y, and the log-likelihood of y by Laplace's form where eta is the mode's, or its part of the bound."""
        seen = np.isfinite(y)
        if not seen.any():
            return m, p, np.zeros(self.s.size)
        z, noise, gain = self.at(y, eta, var, seen, among)
        h = self.s.h[:, seen]
        ph = p @ np.swapaxes(h, -1, -2)
        l = root(h @ ph + noise)
        v = np.linalg.solve(l, (z - (h @ m[..., None])[..., 0] - self.s.d[:, seen])[..., None])[..., 0]
        j = np.swapaxes(np.linalg.solve(l, np.swapaxes(ph, -1, -2)), -1, -2)
        ll = -0.5 * (v**2).sum(axis=-1) - np.log(np.diagonal(l, axis1=-2, axis2=-1)).sum(axis=-1) - seen.sum() / 2 * log(2 * pi)
        p = p - j @ np.swapaxes(j, -1, -2)
        return m + (j @ v[..., None])[..., 0], (p + np.swapaxes(p, -1, -2)) / 2, ll + gain


def _start(e: Emissions, size: int, y: np.ndarray) -> np.ndarray:
    guess = [families.start(f, v) if np.isfinite(v) else 0.0 for f, v in zip(e.families, y.tolist())]
    return np.broadcast_to(np.array(guess), (size, len(guess)))


def _forward(f, key: str, time: str, ys: list[str], last: bool):
    """The filter over rows with eta, or without in the first round. Rows get their place in the series (pos) and what the
    smoother needs; or there is one row a series and system with the likelihood, if last."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = f.value
        s = p.s
        at, series, begun, before, pos, rows, done, total = s.steps(), None, False, 0.0, 0, [], [], np.zeros(s.size)
        names = [key, time, *ys, "pos", "dt", "eta", "var", "mean", "cov", "mean_before", "cov_before"]
        ends = lambda: pd.DataFrame({key: [series] * s.size, "system": np.arange(s.size), "n": pos, "loglik": total})
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for frame in frames:
                none = [None] * len(frame)
                columns = [frame[c].tolist() if c in frame else none for c in (("eta_was", "var_was", "mean", "cov") if last and p.averaged else ("eta", "var", "", ""))]
                for k, t, y, eta, var, own, spread in zip(frame[key].tolist(), frame[time].to_numpy(float), frame[ys].to_numpy(float), *columns):
                    new = not begun or k != series
                    if new:
                        if begun and last:
                            done.append(ends())
                        m, c, pos, total = s.m0, s.p0, 0, np.zeros(s.size)
                    dt = 0.0 if new else t - before
                    series, begun, before = k, True, t
                    if dt > 0:
                        m, c = predict(at(dt), m, c)
                    eta = _start(p.e, s.size, y) if eta is None else np.asarray(eta).reshape(s.size, -1)
                    var = np.zeros_like(eta) if var is None else np.asarray(var).reshape(s.size, -1)
                    among = None if own is None else p.predictor(np.asarray(own).reshape(m.shape), np.asarray(spread).reshape(c.shape))
                    old = m.ravel().tolist(), c.ravel().tolist()
                    m, c, ll = p.conditioned(m, c, y, eta, var, among)
                    total, pos = total + ll, pos + 1
                    if not last:
                        rows.append((k, t, *y.tolist(), pos, dt, eta.ravel().tolist(), var.ravel().tolist(), m.ravel().tolist(), c.ravel().tolist(), *old))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                    if len(done) >= ROWS:
                        yield pd.concat(done)
                        done = []
            if begun and last:
                done.append(ends())
        if rows:
            yield pd.DataFrame(rows, columns=names)
        if done:
            yield pd.concat(done)

    return run


def _backward(f, key: str, time: str, ys: list[str]):
    """Smoothed rows, each with its next predictor and how far that moved."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = f.value.s
        at, n, b, series, begun = s.steps(), s.a.shape[-1], s.size, None, False
        for frame in frames:
            out = []
            for k, dt, eta, m, p, mb, pb in zip(*(frame[c].tolist() for c in (key, "dt", "eta", "mean", "cov", "mean_before", "cov_before"))):
                m, p = np.asarray(m).reshape(b, n), np.asarray(p).reshape(b, n, n)
                if begun and k == series:
                    ad = at(later[0])[0] if later[0] > 0 else np.broadcast_to(np.eye(n), (b, n, n))
                    gain = np.swapaxes(np.linalg.solve(later[2] + 1e-12 * np.eye(n), ad @ p), -1, -2)
                    m = m + (gain @ (ms - later[1])[..., None])[..., 0]
                    p = p + gain @ (ps - later[2]) @ np.swapaxes(gain, -1, -2)
                series, begun, ms, ps = k, True, m, p
                later = dt, np.asarray(mb).reshape(b, n), np.asarray(pb).reshape(b, n, n)
                old = np.asarray(eta).reshape(b, -1)
                own, spread = f.value.predictor(m, p)
                step = np.clip(own - old, -TRUST, TRUST)
                out.append(((old + step).ravel().tolist(), spread.ravel().tolist(), m.ravel().tolist(), p.ravel().tolist(), float(np.abs(step).max(initial=0))))
            made = pd.DataFrame(out, columns=["eta", "var", "mean", "cov", "step"])
            before = frame[[key, time, *ys, "pos", "eta", "var"]].rename(columns={"eta": "eta_was", "var": "var_was"}).reset_index(drop=True)
            yield pd.concat([before, made], axis=1)

    return run


def _rounds(panel: DataFrame, pseudo: Pseudo, key: str, time: str, ys: list[str], rounds: int) -> DataFrame:
    sent = panel.sparkSession.sparkContext.broadcast(pseudo)
    kind = f"{key} {dict(panel.dtypes)[key]}, {time} double, " + "".join(f"{y} double, " for y in ys) + "pos long, "
    forth = kind + "dt double, eta array<double>, var array<double>, mean array<double>, cov array<double>, mean_before array<double>, cov_before array<double>"
    back = kind + "eta_was array<double>, var_was array<double>, eta array<double>, var array<double>, mean array<double>, cov array<double>, step double"
    rows = panel.select(key, F.col(time).cast("double").alias(time), *ys)
    for _ in range(max(rounds, 1)):
        turned = rows.mapInPandas(_forward(sent, key, time, ys, False), forth).sortWithinPartitions(key, F.col("pos").desc())
        rows = cut(turned.mapInPandas(_backward(sent, key, time, ys), back).sortWithinPartitions(key, "pos"))
        moved = rows.agg(F.max("step")).first()[0]
        if moved is None or moved < STILL:
            break
    return rows


def _total(rows: DataFrame, pseudo: Pseudo, key: str, time: str, ys: list[str]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(pseudo)
    return rows.mapInPandas(_forward(sent, key, time, ys, True), f"{key} {dict(rows.dtypes)[key]}, system int, n long, loglik double")


def smoothed(panel: DataFrame, system: System, emissions: Emissions, key: str, time: str, ys: list[str], rounds: int = 15) -> DataFrame:
    """(key, time, ys, pos, eta, mean, cov, step) for each row of the panel (from sort_panel): the predictors and states of each
    system at their mode, with the curvature's covariance, flattened; and the largest change of a predictor in the last
    round. Rounds end when no predictor moves, or when there are no more of them."""
    return _rounds(panel, Pseudo(system, emissions), key, time, ys, rounds).drop("eta_was", "var_was", "var")


def laplace_loglik(panel: DataFrame, system: System, emissions: Emissions, key: str, time: str, ys: list[str], rounds: int = 15) -> DataFrame:
    """(key, system, n, loglik): the integral over all states by Laplace's form at their mode. Exact where all channels are
    normal."""
    pseudo = Pseudo(system, emissions)
    return _total(_rounds(panel, pseudo, key, time, ys, rounds), pseudo, key, time, ys)


def bound_loglik(panel: DataFrame, system: System, emissions: Emissions, key: str, time: str, ys: list[str], rounds: int = 15) -> DataFrame:
    """(key, system, n, loglik): a lower bound of the log-likelihood, from the normal guide over all states that `rounds` come to.
    Exact where all channels are normal, and after any number of rounds not above the integral but for what the rule over
    single predictors leaves."""
    pseudo = Pseudo(system, emissions, averaged=True)
    return _total(_rounds(panel, pseudo, key, time, ys, rounds), pseudo, key, time, ys)
