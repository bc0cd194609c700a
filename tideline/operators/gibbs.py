"""Particle Gibbs with ancestor sampling: paths of all series given parameters, then parameters given paths.

A round draws a new path for each series by a conditional particle filter, in which one particle is held to the path of the
round before but may change its ancestor at every step. Particles and ancestors of each row are written by a walk forwards;
a walk backwards over the same partitions, sorted the other way, follows the ancestors of one particle from the last row.
Tasks hold the particles of one row, however long a series is, and nothing is shuffled.

Given paths, rows do not depend on each other but for the row before: the density and its slopes are sums over rows, and the
parameters make Hamiltonian moves with them. Several chains, each with paths of its own, go side by side in every pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.families import Emissions
from tideline.lineage import cut
from tideline.operators import inference, slopes
from tideline.operators.mixed import root
from tideline.operators.slopes import FIELDS, outer, times, turned
from tideline.operators.statespace import System

ROWS = 500


def _picked(rng: np.random.Generator, logw: np.ndarray, n: int) -> np.ndarray:
    """n independent draws for each row of weights."""
    w = np.exp(logw - logw.max(axis=1, keepdims=True))
    edges = np.cumsum(w, axis=1)
    at = rng.random((len(logw), n)) * edges[:, -1:]
    return np.minimum((at[:, :, None] >= edges[:, None, :]).sum(axis=2), logw.shape[1] - 1)


class Conditional:
    """Particles (chains, particles, n) of one series after another, the last of them held to a path if there is one. They are
    moved given the normal channels of the row that follows, and weighed by the others."""

    def __init__(self, s: System, e: Emissions, particles: int, seed: list[int]):
        self.s, self.e, self.k, self.seed, self.at = s, e, particles, seed, s.steps()
        self.sd = np.sqrt(np.diagonal(s.r, axis1=-2, axis2=-1))

    def step(self, new: bool, dt: float, y: np.ndarray, path: np.ndarray | None, key) -> np.ndarray:
        """Ancestors of the particles after this row."""
        s, chains, n = self.s, self.s.size, self.s.a.shape[-1]
        same = np.broadcast_to(np.arange(self.k), (chains, self.k))
        if new:
            self.rng = np.random.default_rng([*self.seed, zlib.crc32(str(key).encode())])
            mean, q = np.broadcast_to(s.m0[:, None], (chains, self.k, n)), s.p0
            self.logw = np.full((chains, self.k), -log(self.k))
        elif dt > 0:
            ad, q, cd = self.at(dt)
            mean = self.x @ turned(ad) + cd[:, None]
        else:
            mean, q = self.x, np.zeros_like(s.p0)
        seen = np.isfinite(y)
        normal, other = np.flatnonzero(seen & self.e.normal), np.flatnonzero(seen & ~self.e.normal)
        ahead, gain, after = np.zeros((chains, self.k)), None, q
        if len(normal):
            h = s.h[:, normal]
            l = root(h @ q @ turned(h) + s.r[:, normal[:, None], normal])
            v = y[normal] - mean @ turned(h) - s.d[:, None, normal]
            z = np.linalg.solve(l[:, None], v[..., None])[..., 0]
            ahead = -0.5 * (z**2).sum(axis=2) - np.log(np.diagonal(l, axis1=1, axis2=2)).sum(axis=1)[:, None]
            j = turned(np.linalg.solve(l, h @ q))
            gain, after = z @ turned(j), q - j @ turned(j)
        if new or dt == 0:
            came, self.logw = same, self.logw + ahead
        else:
            came = _picked(self.rng, self.logw + ahead, self.k)
            if path is not None:
                gap = np.linalg.solve(root(q)[:, None], (path[:, None] - mean)[..., None])[..., 0]
                came[:, -1] = _picked(self.rng, self.logw - 0.5 * (gap**2).sum(axis=2), 1)[:, 0]
            self.logw = np.full((chains, self.k), -log(self.k))
        moved = mean if gain is None else mean + gain
        noise = self.rng.standard_normal((chains, self.k, n))
        self.x = np.take_along_axis(moved, came[..., None], 1) + (noise @ turned(root(after)) if new or dt > 0 else 0)
        if path is not None:
            self.x[:, -1] = path
        if len(other):
            eta = self.x @ turned(s.h[:, other]) + s.d[:, None, other]
            dens = sum(self.e.scores(int(c), float(y[c]), eta[..., i], self.sd[:, c])[0] for i, c in enumerate(other))
            self.logw = self.logw + np.maximum(dens, -1e30)
        return came


def _forward(sent, key: str, time: str, ys: list[str], held: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, series, begun, before, pos, rows = Conditional(*sent.value), None, False, 0.0, 0, []
        names = [key, time, *ys, "pos", "dt", "x", "came", "logw"]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for frame in frames:
                paths = frame["path"].tolist() if held else [None] * len(frame)
                for k, t, y, path in zip(frame[key].tolist(), frame[time].to_numpy(float), frame[ys].to_numpy(float), paths):
                    new = not begun or k != series
                    dt = 0.0 if new else t - before
                    came = f.step(new, dt, y, None if path is None else np.asarray(path).reshape(f.s.size, -1), k)
                    series, begun, before, pos = k, True, t, 1 if new else pos + 1
                    rows.append((k, t, *y.tolist(), pos, dt, f.x.ravel().tolist(), came.ravel().tolist(), f.logw.ravel().tolist()))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def _traced(sent, key: str, time: str, ys: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, _, particles, seed = sent.value
        chains, n, series, begun = s.size, s.a.shape[-1], None, False
        for frame in frames:
            out = []
            for k, x, came, logw in zip(frame[key].tolist(), frame["x"], frame["came"], frame["logw"]):
                if not begun or k != series:
                    rng = np.random.default_rng([*seed, 1, zlib.crc32(str(k).encode())])
                    spot = _picked(rng, np.asarray(logw).reshape(chains, particles), 1)[:, 0]
                series, begun = k, True
                out.append(np.asarray(x).reshape(chains, particles, n)[np.arange(chains), spot].ravel().tolist())
                spot = np.asarray(came).reshape(chains, particles)[np.arange(chains), spot]
            yield frame[[key, time, *ys, "pos", "dt"]].assign(path=out)

    return run


def swept(paths: DataFrame, system: System, emissions: Emissions, key: str, time: str, ys: list[str], particles: int, seed: list[int]) -> DataFrame:
    """(key, time, ys, pos, dt, path) with a new path (chains times n, row by row) for each chain, a system of the batch. paths:
    such a table, whose paths are then conditioned on, or a sorted panel."""
    sent = paths.sparkSession.sparkContext.broadcast((system, emissions, particles, seed))
    kind = f"{key} {dict(paths.dtypes)[key]}, {time} double, " + "".join(f"{y} double, " for y in ys) + "pos long, dt double, "
    held = "path" in paths.columns
    rows = paths.select(key, F.col(time).cast("double").alias(time), *ys, *(["path"] if held else []))
    forth = rows.mapInPandas(_forward(sent, key, time, ys, held), kind + "x array<double>, came array<int>, logw array<double>")
    back = forth.sortWithinPartitions(key, F.col("pos").desc()).mapInPandas(_traced(sent, key, time, ys), kind + "path array<double>")
    return cut(back.sortWithinPartitions(key, "pos"))


class Given:
    """Density of observations and paths together, and its slopes, for systems that take the chains' paths in turn."""

    def __init__(self, s: System, e: Emissions, chains: int):
        self.s, self.e, self.turn = s, e, np.arange(s.size) % chains
        self.sd = np.sqrt(np.diagonal(s.r, axis1=-2, axis2=-1))
        self.to = {f: np.zeros_like(getattr(s, f), float) for f in FIELDS}
        self.steps: dict[float, list] = {}
        self.total = np.zeros(s.size)
        self.at = s.steps()

    def normal(self, gap: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds the log-densities of gaps (systems, rows, width) and gives the gaps over the covariance, and its slopes."""
        inv = np.linalg.inv(cov)
        w = gap @ inv
        rows = gap.shape[1]
        self.total += -0.5 * ((w * gap).sum(axis=(1, 2)) + rows * (np.linalg.slogdet(cov)[1] + cov.shape[-1] * log(2 * pi)))
        return w, 0.5 * (turned(w) @ w - rows * inv)

    def add(self, x: np.ndarray, before: np.ndarray, dt: np.ndarray, new: np.ndarray, y: np.ndarray) -> None:
        """Rows with their state and the one before (rows, chains, n)."""
        s, to = self.s, self.to
        x, before = (np.swapaxes(v, 0, 1)[self.turn] for v in (x, before))
        if new.any():
            w, g = self.normal(x[:, new] - s.m0[:, None], s.p0)
            to["m0"] += w.sum(axis=1)
            to["p0"] += g
        for step in np.unique(dt[(dt > 0) & ~new]).tolist():
            rows = (dt == step) & ~new
            ad, qd, cd = self.at(step)
            w, g = self.normal(x[:, rows] - before[:, rows] @ turned(ad) - cd[:, None], qd)
            mine = self.steps.setdefault(step, [np.zeros_like(s.a), np.zeros_like(s.q), np.zeros_like(s.c)])
            for held, more in zip(mine, (turned(w) @ before[:, rows], g, w.sum(axis=1))):
                held += more
        if len(self.steps) > slopes.BLOCK:
            self.settle()
        seen = np.isfinite(y)
        usual = seen & self.e.normal
        for pattern in np.unique(usual, axis=0):
            c, rows = np.flatnonzero(pattern), (usual == pattern).all(axis=1)
            if len(c):
                w, g = self.normal(y[rows][:, c] - x[:, rows] @ turned(s.h[:, c]) - s.d[:, None, c], s.r[:, c[:, None], c])
                to["d"][:, c] += w.sum(axis=1)
                to["h"][:, c] += turned(w) @ x[:, rows]
                to["r"][:, c[:, None], c] += g
        for c in np.flatnonzero(~self.e.normal):
            for value in np.unique(y[seen[:, c], c]).tolist():
                rows = seen[:, c] & (y[:, c] == value)
                eta = (x[:, rows] @ s.h[:, c, :, None])[..., 0] + s.d[:, c, None]
                dens, slope, _, _ = self.e.scores(int(c), value, eta, self.sd[:, c])
                self.total += dens.sum(axis=1)
                to["d"][:, c] += slope.sum(axis=1)
                to["h"][:, c] += (slope[:, None] @ x[:, rows])[:, 0]

    def settle(self) -> None:
        for dt, g in self.steps.items():
            slopes._discretised_back(self.s, dt, *g, self.to)
        self.steps.clear()


def given_paths(paths: DataFrame, system: System, emissions: Emissions, chains: int, key: str, ys: list[str]) -> DataFrame:
    """(system, entry, value) as `slopes.value_and_slopes` gives them, of observations and paths together. Slopes in what
    shapes a family that is not normal are left out; a Hamiltonian move does not need them to be right."""
    sent = paths.sparkSession.sparkContext.broadcast((system, emissions, chains))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, last, some = Given(*sent.value), None, False
        n = f.s.a.shape[-1]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for frame in frames:
                for i in range(0, len(frame), ROWS):
                    part = frame.iloc[i : i + ROWS]
                    x = np.stack(part["path"].tolist()).reshape(len(part), chains, n)
                    f.add(x, np.concatenate([x[:1] if last is None else last[None], x[:-1]]), part["dt"].to_numpy(float), part["pos"].to_numpy() == 1, part[ys].to_numpy(float))
                    last, some = x[-1], True
            if not some:
                return
            f.settle()
        flat = np.concatenate([f.total[:, None], *[f.to[name].reshape(f.s.size, -1) for name in FIELDS]], axis=1)
        yield pd.DataFrame({"system": np.repeat(np.arange(f.s.size), flat.shape[1]), "entry": np.tile(np.arange(flat.shape[1]), f.s.size), "value": flat.ravel()})

    return paths.mapInPandas(run, "system int, entry int, value double").groupBy("system", "entry").agg(F.sum("value").alias("value"))


class OnPaths:
    """What the moves of `inference` ask of a target, given the paths of all chains."""

    def __init__(self, target: inference.Target, paths: DataFrame, chains: int):
        self.target, self.model, self.paths, self.chains = target, target.model, paths, chains

    def value_and_slope(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, _, ys = self.target.on
        inside, held = self.target.held(theta)
        system = self.model.build(held)
        rows = given_paths(self.paths, system, emissions_of(self.target, held), self.chains, key, ys).toArrow()
        table = np.zeros((len(theta), 1 + sum(getattr(system, f)[0].size for f in FIELDS)))
        table[rows.column("system").to_numpy(), rows.column("entry").to_numpy()] = rows.column("value").to_numpy()
        slope = slopes.chained(system, table[:, 1:], self.model.build, held)
        fine = inside & np.isfinite(table).all(axis=1)
        return np.where(fine, table[:, 0], -1e30), np.where(fine[:, None], np.nan_to_num(slope), 0.0)

    def curvature(self, theta: np.ndarray, eps: float = 1e-3) -> np.ndarray:
        """Minus the second derivatives at each chain, averaged."""
        dim = theta.shape[1]
        around = theta[None] + (np.concatenate([np.eye(dim), -np.eye(dim)]) * eps)[:, None]
        g = inference._posterior(self, around.reshape(-1, dim))[2].reshape(2, dim, len(theta), dim)
        hess = -(g[0] - g[1]).mean(axis=1) / (2 * eps)
        values, vectors = np.linalg.eigh((hess + hess.T) / 2)
        return (vectors * np.maximum(np.abs(values), 1.0)) @ vectors.T


def emissions_of(target: inference.Target, theta: np.ndarray) -> Emissions:
    return target.model.emissions(theta) if target.model.emissions else Emissions(["gaussian"] * len(target.on[2]))


def pgas(target: inference.Target, chains: int = 4, particles: int = 30, rounds: int = 100, moves: int = 2, leaps: int = 5, warm: int | None = None, seed: int = 0) -> DataFrame:
    """Chains started around the mode of the target's likelihood. Each round draws paths, then moves the parameters given
    them `moves` times; the first third, or `warm` rounds, are not kept. The mass is the curvature given the paths, taken
    anew at a few rounds of the warm-up, in which the step size is tuned as well."""
    model, rng = target.model, np.random.default_rng(seed)
    warm = rounds // 3 if warm is None else warm
    centre, curve = inference.mode(target)
    theta = centre + 0.5 * rng.standard_normal((chains, len(centre))) @ np.linalg.cholesky(np.linalg.inv(curve)).T
    paths, step, kept = target.panel, inference.StepSize(0.3, 0.75), []
    for n in range(rounds):
        paths = swept(paths, model.build(theta), emissions_of(target, theta), *target.on, particles, [seed, n])
        on = OnPaths(target, paths, chains)
        if n in (0, warm // 3, warm - 1) or n == 0:
            mass = np.linalg.cholesky(np.linalg.inv(on.curvature(theta)))
        ll, value, slope = inference._posterior(on, theta)
        for _ in range(moves):
            theta, ll, value, slope, likely = inference._hmc_move(on, theta, ll, value, slope, mass, step.size, leaps, 1.0, rng)
            if n < warm:
                step.learn(float(likely.mean()))
        if n == warm - 1:
            step.settle()
        if n >= warm:
            kept.append(theta)
    made = np.concatenate(kept)
    return inference.draws(target.panel, model, made, np.full(len(made), 1 / len(made)))
