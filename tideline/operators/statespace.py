"""Linear continuous-time state-space models over many irregular series.

A panel has a row for each series and time. Series are dealt out and sorted by Spark; a task walks through its rows in
order and holds the state of one series at a time, so memory does not grow with a series' length. A pass evaluates a whole
batch of systems at once, which is what the samplers ask for: one job for each round, whatever the number of particles.
Likelihoods of channels whose noise is apart take many series side by side (see `lockstep`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import linear, sampling
from tideline.operators import lockstep

#: Discretisations kept by a task, one for each interval.
KEPT = 256


@dataclass
class System:
    """d eta = (a eta + c) dt + noise of covariance q; y = h eta + d + noise of covariance r; eta starts as N(m0, p0).
    Every array has the batch as its leading axis."""

    a: np.ndarray
    q: np.ndarray
    c: np.ndarray
    h: np.ndarray
    d: np.ndarray
    r: np.ndarray
    m0: np.ndarray
    p0: np.ndarray

    @staticmethod
    def one(**arrays) -> System:
        return System(**{k: np.asarray(v, float)[None] for k, v in arrays.items()})

    @property
    def size(self) -> int:
        return len(self.a)

    def steps(self) -> Callable[[float], tuple]:
        held: dict[float, tuple] = {}

        def at(dt: float):
            if dt not in held:
                if len(held) >= KEPT:
                    held.pop(next(iter(held)))
                held[dt] = linear.discretize(self.a, self.q, self.c, dt)
            return held[dt]

        return at


def sort_panel(panel: DataFrame, key: str, time: str) -> DataFrame:
    """The panel as the passes below read it: all rows of a series together and in order. The number of partitions is
    named, since few bytes can be much work."""
    n = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return panel.where(F.col(time).isNotNull()).repartition(n, key).sortWithinPartitions(key, time)


def predict(step: tuple, m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ad, qd, cd = step
    return (ad @ m[..., None])[..., 0] + cd, ad @ p @ np.swapaxes(ad, -1, -2) + qd


def update(s: System, m: np.ndarray, p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Mean, covariance and log-likelihood after y; missing channels are left out, which is their exact marginal."""
    seen = np.isfinite(y)
    if not seen.any():
        return m, p, 0.0
    h = s.h[:, seen]
    v = y[seen] - (h @ m[..., None])[..., 0] - s.d[:, seen]
    ph = p @ np.swapaxes(h, -1, -2)
    cov = h @ ph + s.r[:, seen][:, :, seen]
    gain = np.swapaxes(np.linalg.solve(cov, np.swapaxes(ph, -1, -2)), -1, -2)
    m = m + (gain @ v[..., None])[..., 0]
    p = p - gain @ cov @ np.swapaxes(gain, -1, -2)
    quad = (v * np.linalg.solve(cov, v[..., None])[..., 0]).sum(axis=-1)
    return m, (p + np.swapaxes(p, -1, -2)) / 2, -0.5 * (seen.sum() * log(2 * pi) + np.linalg.slogdet(cov)[1] + quad)


def walk(frames: Iterator[pd.DataFrame], key: str, time: str, ys: list[str]) -> Iterator[tuple]:
    """(series, is its first row, days since the row before, time, y) in order."""
    series, before, begun = None, 0.0, False
    for own, at, rows in lockstep.taken(frames, key, time, ys):
        for k, t, y in zip(own.tolist(), at, rows):
            new = not begun or k != series
            yield k, new, 0.0 if new else t - before, t, y
            series, before, begun = k, t, True


def loglik(panel: DataFrame, system: System, key: str, time: str, ys: list[str]) -> DataFrame:
    """(key, system, n, loglik) for each series and each system of the batch. panel: from sort_panel. The first row is
    judged by the initial state; rows of equal time follow each other without dynamics."""
    run = _loglik(panel.sparkSession.sparkContext.broadcast(system), key, time, ys)
    kind = dict(panel.dtypes)[key]
    return panel.mapInPandas(run, f"{key} {kind}, system int, n long, loglik double")


def total_loglik(panel: DataFrame, system: System, key: str, time: str, ys: list[str]) -> DataFrame:
    """(system, loglik), to be added up: what `loglik` gives, summed over the series of each task."""
    return summed(panel, _loglik(panel.sparkSession.sparkContext.broadcast(system), key, time, ys), system.size)


def summed(panel: DataFrame, run: Callable, size: int) -> DataFrame:
    """(system, loglik) of each task, from a walk that gives rows of each series."""

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, some = np.zeros(size), False
        for made in run(frames):
            out += made["loglik"].to_numpy(float).reshape(-1, size).sum(axis=0)
            some = some or len(made) > 0
        if some:
            yield pd.DataFrame({"system": np.arange(size), "loglik": out})

    return panel.mapInPandas(total, "system int, loglik double")


def of_series(key: str, keys: np.ndarray, n: np.ndarray, total: np.ndarray) -> pd.DataFrame:
    """Rows of a likelihood. total: (systems, series)."""
    b = len(total)
    return pd.DataFrame({key: np.repeat(keys, b), "system": np.tile(np.arange(b), len(keys)), "n": np.repeat(n, b), "loglik": total.T.ravel()})


def _loglik(sent, key: str, time: str, ys: list[str]):
    def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sent.value
        f, held = lockstep.Filter(s), None
        for chunk in lockstep.chunks(frames, key, time, ys, lockstep.rows_at_once(s.size), whole=False):
            n = chunk.sizes.copy()
            if chunk.goes_on is not None:
                n[chunk.goes_on] += held[1]
            elif held is not None:
                yield of_series(key, held[0], np.array([held[1]]), held[2][2][:, None])
            f.walk(chunk, None if held is None else held[2])
            done = np.arange(len(n)) != chunk.last
            if done.any():
                yield of_series(key, chunk.keys[done], n[done], f.total[:, done])
            held = chunk.keys[chunk.last : chunk.last + 1], n[chunk.last], f.state(chunk.last)
        if held is not None:
            yield of_series(key, held[0], np.array([held[1]]), held[2][2][:, None])

    def one_by_one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sent.value
        at, done, series, n = s.steps(), [], None, 0
        total = np.zeros(s.size)
        out = lambda: pd.DataFrame({key: [series] * s.size, "system": np.arange(s.size), "n": n, "loglik": total})
        for k, new, dt, _, y in walk(frames, key, time, ys):
            if new:
                if n:
                    done.append(out())
                    if len(done) * s.size > 10_000:
                        yield pd.concat(done)
                        done = []
                series, n, total, m, p = k, 0, np.zeros(s.size), s.m0, s.p0
            elif dt > 0:
                m, p = predict(at(dt), m, p)
            m, p, ll = update(s, m, p, y)
            total = total + ll
            n += 1
        if n:
            done.append(out())
        if done:
            yield pd.concat(done)

    return together if lockstep.Filter.serves(sent.value) else one_by_one


def filtered(panel: DataFrame, system: System, key: str, time: str, ys: list[str]) -> DataFrame:
    """One row for each row of the panel: mean and cov (row by row) after it, and mean_before and cov_before it."""
    sent = panel.sparkSession.sparkContext.broadcast(system)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sent.value
        at, rows = s.steps(), []
        for k, new, dt, t, y in walk(frames, key, time, ys):
            m, p = (s.m0, s.p0) if new else predict(at(dt), m, p) if dt > 0 else (m, p)
            before = m[0].tolist(), p[0].ravel().tolist()
            m, p, _ = update(s, m, p, y)
            rows.append((k, t, dt, m[0].tolist(), p[0].ravel().tolist(), *before))
            if len(rows) == 5_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    names = [key, time, "dt", "mean", "cov", "mean_before", "cov_before"]
    arrays = ", ".join(f"{c} array<double>" for c in names[3:])
    return panel.mapInPandas(run, f"{key} {dict(panel.dtypes)[key]}, {time} double, dt double, {arrays}")


def smoothed(panel: DataFrame, system: System, key: str, time: str, ys: list[str]) -> DataFrame:
    """(key, time, mean, cov) given the whole series: the filter's rows walked backwards, again one state at a time."""
    sent = panel.sparkSession.sparkContext.broadcast(system)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sent.value
        at, n, series, begun = s.steps(), s.a.shape[-1], None, False
        for f in frames:
            means, covs = [], []
            for k, dt, m, p, mb, pb in zip(f[key].tolist(), f["dt"], f["mean"], f["cov"], f["mean_before"], f["cov_before"]):
                m, p = np.array(m), np.array(p).reshape(n, n)
                if begun and k == series:
                    ad = at(later[0])[0][0] if later[0] > 0 else np.eye(n)
                    gain = np.linalg.solve(later[2], ad @ p).T
                    m, p = m + gain @ (ms - later[1]), p + gain @ (ps - later[2]) @ gain.T
                series, begun, ms, ps = k, True, m, p
                later = dt, np.array(mb), np.array(pb).reshape(n, n)
                means.append(m.tolist())
                covs.append(p.ravel().tolist())
            yield pd.DataFrame({key: f[key], time: f[time], "mean": means, "cov": covs})

    back = filtered(panel, system, key, time, ys).repartition(key).sortWithinPartitions(key, F.col(time).desc(), F.col("dt").asc())
    return back.mapInPandas(run, f"{key} {dict(panel.dtypes)[key]}, {time} double, mean array<double>, cov array<double>")


def simulate(spark: SparkSession, system: System, series: int, times: int, dt: float, family: str = "gaussian", seed: int = 0) -> DataFrame:
    """(series, t, y0, y1, ...): series of `times` observations, dt apart, from the first system of the batch."""
    sent = spark.sparkContext.broadcast(system)
    m = system.h.shape[-2]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sent.value
        ad, qd, cd = (z[0] for z in linear.discretize(s.a, s.q, s.c, dt))
        for f in frames:
            for k in f["id"].tolist():
                rng = np.random.default_rng([seed, k])
                x = rng.multivariate_normal(s.m0[0], s.p0[0])
                out = np.empty((times, m))
                for i in range(times):
                    if i:
                        x = ad @ x + cd + rng.multivariate_normal(np.zeros(len(x)), qd)
                    eta = s.h[0] @ x + s.d[0]
                    out[i] = rng.poisson(np.exp(np.minimum(eta, 20))) if family == "poisson" else eta + rng.multivariate_normal(np.zeros(m), s.r[0])
                yield pd.DataFrame({"series": k, "t": np.arange(times) * dt, **{f"y{j}": out[:, j] for j in range(m)}})

    return spark.range(series).mapInPandas(run, "series long, t double, " + ", ".join(f"y{j} double" for j in range(m)))


def predictive(draws: DataFrame, times: list[float], channels: list[str], families: list[str], seed: int = 0) -> DataFrame:
    """(draw, variable, t, value): one replicate of the observations for each draw of the parameters, each channel by its own
    family. draws: draw, and as arrays drift, diffusion (a root of the noise), loading (all row by row), cint, mean, noise (sd
    of each channel), start and start_sd (of the state at the first time), and if need be shapes (of each channel's family, null
    where it has none). A draw gives the same replicate on every run; one whose system cannot be discretised gives null
    values."""
    shaped = "shapes" in draws.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = f["shapes"] if shaped else [[None] * len(channels)] * len(f)
            for draw, shape, *arrays in zip(f["draw"].tolist(), own, *(f[c] for c in PARAMETERS)):
                a, g, h, c, d, sd, x, spread = (np.asarray(v, float) for v in arrays)
                n = len(c)
                a, g, h = a.reshape(n, n), g.reshape(n, n), h.reshape(-1, n)
                rng, out = np.random.default_rng([seed, draw]), np.full((len(times), len(channels)), np.nan)
                try:
                    x = x + spread * rng.standard_normal(n)
                    for i, t in enumerate(times):
                        if i and t > times[i - 1]:
                            ad, qd, cd = (z[0] for z in linear.discretize(a[None], (g @ g.T)[None], c[None], t - times[i - 1]))
                            x = ad @ x + cd + np.linalg.cholesky(qd + 1e-12 * np.eye(n)) @ rng.standard_normal(n)
                        loc = h @ x + d
                        out[i] = [sampling.draw(rng, family, loc[j : j + 1], sd[j], shape[j])[0] for j, family in enumerate(families)]
                except np.linalg.LinAlgError:
                    out[:] = np.nan
                yield pd.DataFrame({"draw": draw, "variable": np.tile(channels, len(times)), "t": np.repeat(np.asarray(times, float), len(channels)), "value": out.ravel()})

    made = draws.select("draw", *PARAMETERS, *(["shapes"] if shaped else [])).mapInPandas(run, "draw long, variable string, t double, value double")
    return made.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


PARAMETERS = ("drift", "diffusion", "loading", "cint", "mean", "noise", "start", "start_sd")
