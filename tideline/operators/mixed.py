"""Filters for series whose channels need not be normal.

Given what is sampled, the rest of a state is normal; a particle therefore is a mean and a covariance. Normal channels are
conditioned on exactly. Of others the density is integrated over the predictor by a rule centred at its peak, which gives the
particle's weight; then either the moments of that integral are kept (no random numbers at all if nothing else is sampled), or
the predictor is drawn and conditioned on, which makes the likelihood unbiased. Latent variables can be sampled as well, and
must not be normal: noise of Student's t is normal given a scale, which is drawn.

One pass goes over the sorted rows of a panel, for many series and a batch of systems at once (see `lockstep`): to a filter,
each pair of a series and a system is a system of its own. A series' random numbers come from its key, so a lost task repeats
them, and all systems use the same ones.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tideline.functions import families, quadrature
from tideline.functions.families import Emissions
from tideline.operators import lockstep
from tideline.operators.statespace import System, of_series, predict, summed, update

#: Newton steps to the peak, shorter lengths tried where a whole step leads down, how near to the peak is near enough (the
#: rule around it corrects for the rest), and the share of draws that come from before the observation, which bounds their
#: weights.
STEPS, SHORTER, NEAR, DEFENSIVE = 15, (0.4, 0.1, 0.02), 1e-6, 0.1
#: Added to what is inverted, relative to its size; least degrees of freedom of noise.
JITTER, LEAST_DF = 1e-12, 2.1
#: Points of all series, systems and particles in a chunk.
POINTS = 1 << 20


@dataclass
class Settings:
    """points, rule: of the quadrature. particles: how many. exact: predictors are drawn instead of keeping moments.
    sampled: latent variables that are drawn. df: of the noise of latent variables, None where it is normal."""

    points: int = 12
    rule: str = "gauss_hermite"
    particles: int = 1
    exact: bool = False
    sampled: list[int] = field(default_factory=list)
    df: list[float | None] | None = None
    seed: int = 0


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of stacks of small matrices."""
    return a * b if a.shape[-1] == 1 else a @ b


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return b / a if a.shape[-1] == 1 else np.linalg.solve(a, b)


def root(s: np.ndarray) -> np.ndarray:
    """Lower triangle l with l l' = s, for s that may be zero."""
    if s.shape[-1] == 1:
        return np.sqrt(s * (1 + JITTER) + 1e-300)
    size = np.trace(s, axis1=-2, axis2=-1)[..., None, None] / s.shape[-1]
    return np.linalg.cholesky(s + (JITTER * size + 1e-300) * np.eye(s.shape[-1]))


def conditioned(m: np.ndarray, p: np.ndarray, l: np.ndarray, ph: np.ndarray, z: np.ndarray, spread: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """State after its predictor (of root l and covariance ph with the state) is l z above its mean, or has z and spread as
    mean and covariance of that multiple."""
    j = np.swapaxes(solve(l, np.swapaxes(ph, -1, -2)), -1, -2)
    p = p - mul(j, np.swapaxes(j, -1, -2))
    if spread is not None:
        p = p + mul(mul(j, spread), np.swapaxes(j, -1, -2))
    return m + mul(j, z[..., None])[..., 0], (p + np.swapaxes(p, -1, -2)) / 2


def spots(rng: np.random.Generator, n: int) -> np.ndarray:
    return (rng.random() + np.arange(n)) / n


class Mixed:
    """The filters of many series: begin, then for each row of the first of them move those with an interval, and see; or of
    one series by start, move and see. total is the log-likelihood of each pair of a series and a system so far, systems
    within series. An observation that no particle allows makes it -inf, and the series goes on without that row."""

    STATE = ("m", "p", "logw", "total")

    def __init__(self, system: System, emissions: Emissions, how: Settings):
        self.system, self.emissions, self.how = system, emissions, how
        self.steps = lockstep.Steps(system)
        self.sds = np.sqrt(np.diagonal(system.r, axis1=-2, axis2=-1))
        self.df = np.array([np.inf if x is None else max(x, LEAST_DF) for x in how.df or [None] * system.a.shape[-1]])
        self.draws = how.particles > 1 or how.exact or bool(how.sampled) or bool(np.isfinite(self.df).any())

    def begin(self, keys) -> None:
        k, n, size = self.how.particles, self.system.a.shape[-1], len(keys)
        self.rngs = [np.random.default_rng([self.how.seed, zlib.crc32(str(x).encode())]) for x in keys] if self.draws else [None] * size
        many = lambda x: np.tile(x, (size,) + (1,) * (x.ndim - 1))
        self.h, self.d, self.r, self.sd = many(self.system.h), many(self.system.d), many(self.system.r), many(self.sds)
        self.shapes = {f: many(np.broadcast_to(v, (self.system.size, v.shape[1]))) for f, v in self.emissions.shapes.items()}
        self.e = Emissions(self.emissions.families, self.shapes)
        self.m = np.repeat(many(self.system.m0)[:, None], k, axis=1)
        self.p = np.repeat(many(self.system.p0)[:, None], k, axis=1)
        self.logw = np.full((len(self.m), k), -log(k))
        self.total = np.zeros(len(self.m))
        self.drawn()

    def start(self, key) -> None:
        self.begin([key])

    def move(self, dt: float) -> None:
        self.move_rows(self.steps.take(np.array([dt])))

    def see(self, y: np.ndarray) -> None:
        self.see_rows(y[None])

    def among(self, series: np.ndarray | slice) -> Mixed:
        """The same with some of the series, to be given back by `back`."""
        out, b = copy.copy(self), self.system.size
        out.at = slice(0, series.stop * b) if isinstance(series, slice) else (series[:, None] * b + np.arange(b)).ravel()
        for x in (*self.STATE, "h", "d", "r", "sd"):
            setattr(out, x, getattr(self, x)[out.at])
        out.e = Emissions(self.emissions.families, {f: v[out.at] for f, v in self.shapes.items()})
        out.rngs = self.rngs[series] if isinstance(series, slice) else [self.rngs[i] for i in series]
        return out

    def back(self, part: Mixed) -> None:
        for x in self.STATE:
            getattr(self, x)[part.at] = getattr(part, x)

    def move_rows(self, place: np.ndarray) -> None:
        """The first series, as many as place has: intervals by their place among the steps, of which zero is none."""
        there = np.flatnonzero(self.steps.values[place] > 0)
        if len(there):
            part = self.among(slice(0, len(place)) if len(there) == len(place) else there)
            part.moved(*(np.moveaxis(x.take(place[there], axis=-1), (-1, -2), (0, 1)).reshape(-1, *x.shape[:-2]) for x in self.steps.table))
            self.back(part)

    def moved(self, ad: np.ndarray, qd: np.ndarray, cd: np.ndarray) -> None:
        q = qd[:, None]
        if np.isfinite(self.df).any():
            scale = np.ones((len(self.rngs), self.how.particles, len(self.df)))
            for i in np.flatnonzero(np.isfinite(self.df)):
                scale[..., i] = [np.sqrt((self.df[i] - 2) / r.chisquare(self.df[i], self.how.particles)) for r in self.rngs]
            scale = np.repeat(scale, self.system.size, axis=0)
            q = q * scale[..., :, None] * scale[..., None, :]
        self.m = mul(ad[:, None], self.m[..., None])[..., 0] + cd[:, None]
        self.p = mul(mul(ad[:, None], self.p), np.swapaxes(ad, -1, -2)[:, None]) + q
        self.drawn()

    def each(self, draw) -> np.ndarray:
        """Random numbers of each series, for all systems."""
        return np.repeat(np.stack([draw(r) for r in self.rngs]), self.system.size, axis=0)

    def drawn(self) -> None:
        """Draws the sampled variables and conditions the others on them, across all covariances."""
        if self.how.sampled and len(self.rngs):
            s = self.how.sampled
            l = root(self.p[..., s, :][..., s])
            z = self.each(lambda r: r.standard_normal((self.how.particles, len(s))))
            self.m, self.p = conditioned(self.m, self.p, l, self.p[..., s], z)

    def see_rows(self, y: np.ndarray) -> None:
        """A row of each of the first series."""
        seen = np.isfinite(y)
        patterns, of = np.unique(seen, axis=0, return_inverse=True)
        of = of.reshape(-1)
        for k, pattern in enumerate(patterns):
            if pattern.any():
                part = self.among(slice(0, len(y)) if len(patterns) == 1 else np.flatnonzero(of == k))
                part.saw(pattern, y if len(patterns) == 1 else y[of == k])
                self.back(part)

    def saw(self, there: np.ndarray, y: np.ndarray) -> None:
        gain = np.zeros_like(self.logw)
        if (normal := np.flatnonzero(there & self.e.normal)).size:
            gain = gain + self.exactly(normal, np.repeat(y[:, normal], self.system.size, axis=0))
        if (others := np.flatnonzero(there & ~self.e.normal)).size:
            self.rest = [np.broadcast_to(self.emissions.rest(int(j), y[:, j]), (len(y), self.system.size)).ravel() for j in others]
            gain = gain + self.integrated(others, np.repeat(y[:, others], self.system.size, axis=0))
        logw = self.logw + gain
        top = logw.max(axis=1)
        fine = np.isfinite(top)
        self.total = np.where(fine, self.total + np.where(fine, top, 0.0), -np.inf)
        w = np.where(fine[:, None], np.exp(logw - np.where(fine, top, 0.0)[:, None]), np.exp(self.logw))
        whole = w.sum(axis=1, keepdims=True)
        self.total = self.total + np.where(fine, np.log(whole[:, 0]), 0.0)
        w = w / whole
        if self.how.particles > 1:
            self.resampled(w)

    def resampled(self, w: np.ndarray) -> None:
        """Systems of which fewer than half the particles count deal them anew."""
        n = self.how.particles
        at = self.each(lambda r: spots(r, n))
        with np.errstate(divide="ignore"):
            self.logw = np.log(w)
        for b in np.flatnonzero(1 / (w**2).sum(axis=1) < n / 2):
            take = np.minimum(np.searchsorted(np.cumsum(w[b]), at[b]), n - 1)
            self.m[b], self.p[b], self.logw[b] = self.m[b, take], self.p[b, take], -log(n)

    def predictor(self, channels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self.h[:, None, channels]
        ph = mul(self.p, np.swapaxes(h, -1, -2))
        return mul(h, self.m[..., None])[..., 0] + self.d[:, None, channels], ph, mul(h, ph)

    def exactly(self, channels: np.ndarray, y: np.ndarray) -> np.ndarray:
        eta, ph, s = self.predictor(channels)
        s = s + self.r[:, None, channels][..., channels]
        l = np.sqrt(s) if len(channels) == 1 else np.linalg.cholesky(s)
        z = solve(l, (y[:, None] - eta)[..., None])[..., 0]
        self.m, self.p = conditioned(self.m, self.p, l, ph, z)
        return -0.5 * (z**2).sum(axis=-1) - np.log(np.diagonal(l, axis1=-2, axis2=-1)).sum(axis=-1) - len(channels) / 2 * log(2 * pi)

    def density(self, channels: np.ndarray, y: np.ndarray, eta: np.ndarray) -> np.ndarray:
        """Log-density of all channels together."""
        return sum(self.e.scores(int(j), y[:, i], eta[..., i], self.sd[:, j], self.rest[i], only=True)[0] for i, j in enumerate(channels))

    def peaks(self, channels: np.ndarray, y: np.ndarray, eta: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Multiples z of l at which each particle's density of the observation is highest, times that of z, and the channels'
        curvature (never negative) there. Each particle stops at its own peak, whatever goes on beside it."""
        b, k, c = eta.shape
        pair = np.repeat(np.arange(b), k)
        eta, l = eta.reshape(-1, c), l.reshape(-1, c, c)

        def height(z: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            of, there = pair[at], eta[at] + mul(l[at], z[..., None])[..., 0]
            got = [
                families.scores(self.e.families[j], y[of, i], there[:, i], sd=self.sd[of, j], rest=self.rest[i][of], **{f: v[of, j] for f, v in self.e.shapes.items()})
                for i, j in enumerate(channels.tolist())
            ]
            curve = [np.where(g[2] > 0, g[2], g[3]) for g in got]
            return sum(g[0] for g in got) - 0.5 * (z**2).sum(axis=-1), np.stack([g[1] for g in got], axis=-1), np.stack(curve, axis=-1)

        z, at = np.zeros_like(eta), np.arange(len(eta))
        best, slope, curve = height(z, at)
        curves = curve.copy()
        for _ in range(STEPS):
            own = l[at]
            lt = np.swapaxes(own, -1, -2)
            step = solve(np.eye(c) + mul(lt, curve[..., None] * own), (mul(lt, slope[..., None])[..., 0] - z[at])[..., None])[..., 0]
            far = np.abs(step).max(axis=-1) >= NEAR
            tried = z[at] + step
            found, slope, curve = height(tried, at)
            for length in SHORTER:
                down = np.flatnonzero(~(found >= best) & far)
                if not len(down):
                    break
                tried[down] = z[at[down]] + length * step[down]
                found[down], slope[down], curve[down] = height(tried[down], at[down])
            up = found >= best
            z[at[up]], curves[at[up]] = tried[up], curve[up]
            go = up & far
            at, best, slope, curve = at[go], found[go], slope[go], curve[go]
            if not len(at):
                break
        return z.reshape(b, k, c), curves.reshape(b, k, c)

    def integrated(self, channels: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log of the integral of the channels' density over the predictor eta + l z, z standard normal."""
        eta, ph, s = self.predictor(channels)
        c, l = len(channels), root(s)
        lt = np.swapaxes(l, -1, -2)
        z, curve = self.peaks(channels, y, eta, l)
        around = np.eye(c) + mul(lt, curve[..., None] * l)
        wide = root(1 / around if c == 1 else np.linalg.inv(around))
        u, weight = quadrature.rule(c, self.how.points, self.how.rule)
        z = z[..., None, :] + mul(u, np.swapaxes(wide, -1, -2))  # systems, particles, points, channels
        eta_at = eta[..., None, :] + mul(z, np.swapaxes(l, -1, -2))
        dens = self.density(channels, y, eta_at)
        logv = np.log(weight) + dens - 0.5 * (z**2).sum(axis=-1) + 0.5 * (u**2).sum(axis=-1)
        top = logv.max(axis=-1, keepdims=True)
        fine = np.isfinite(top)
        v = np.where(fine, np.exp(logv - np.where(fine, top, 0)), 1 / len(u))
        whole = v.sum(axis=-1, keepdims=True)
        total = np.where(fine[..., 0], top[..., 0] + np.log(whole[..., 0]), -np.inf) + np.log(np.diagonal(wide, axis1=-2, axis2=-1)).sum(axis=-1)
        v = v / whole
        mean = (v[..., None] * z).sum(axis=-2)
        apart = z - mean[..., None, :]
        spread = (v * apart[..., 0] ** 2).sum(axis=-1)[..., None, None] if c == 1 else np.swapaxes(apart, -1, -2) @ (v[..., None] * apart)
        keep = ~fine[..., 0]
        if self.how.exact:
            return self.drawn_predictor(channels, y, eta, ph, l, mean, spread, keep)
        m, p = conditioned(self.m, self.p, l, ph, mean, spread)
        self.m, self.p = np.where(keep[..., None], self.m, m), np.where(keep[..., None, None], self.p, p)
        return total

    def drawn_predictor(self, channels, y, eta, ph, l, mean, spread, keep) -> np.ndarray:
        """Draws the predictor near where it is after the observation, and gives the weight that this needs. A share is drawn
        from before it: the density of an observation is bounded, so the weights are."""
        k, c = self.how.particles, len(channels)
        wide = root(spread)
        both = [(r.standard_normal((k, c)), r.random(k)) for r in self.rngs]
        g, share = (np.repeat(np.stack(x), self.system.size, axis=0) for x in zip(*both))
        z = np.where((share < DEFENSIVE)[..., None], g, mean + mul(wide, g[..., None])[..., 0])
        near = solve(wide, (z - mean)[..., None])[..., 0]
        before = -0.5 * (z**2).sum(axis=-1)
        after = -0.5 * (near**2).sum(axis=-1) - np.log(np.diagonal(wide, axis1=-2, axis2=-1)).sum(axis=-1)
        dens = self.density(channels, y, eta + mul(l, z[..., None])[..., 0])
        m, p = conditioned(self.m, self.p, l, ph, z)
        self.m, self.p = np.where(keep[..., None], self.m, m), np.where(keep[..., None, None], self.p, p)
        return dens + before - np.logaddexp(log(DEFENSIVE) + before, log(1 - DEFENSIVE) + after)


class Kalman:
    """The same steps for normal channels and noise alone."""

    def __init__(self, system: System):
        self.s, self.at = system, system.steps()

    def start(self, key) -> None:
        self.m, self.p, self.total = self.s.m0, self.s.p0, np.zeros(self.s.size)

    def move(self, dt: float) -> None:
        self.m, self.p = predict(self.at(dt), self.m, self.p)

    def see(self, y: np.ndarray) -> None:
        self.m, self.p, ll = update(self.s, self.m, self.p, y)
        self.total = self.total + ll


class Beside:
    """A Kalman filter with the steps of `Mixed`, for noise of channels that is apart."""

    def __init__(self, system: System):
        self.f = lockstep.Filter(system)
        self.steps = self.f.steps

    @property
    def total(self) -> np.ndarray:
        return self.f.total.T.ravel()

    def begin(self, keys) -> None:
        self.f.begin(len(keys))
        self.step = None

    def move_rows(self, place: np.ndarray) -> None:
        self.step = self.steps.of(place) if (self.steps.values[place] > 0).any() else None

    def see_rows(self, y: np.ndarray) -> None:
        self.f.forward(y, self.step)
        self.step = None


def distinct(s: System, e: Emissions) -> tuple[System, Emissions, np.ndarray]:
    """Each system of a batch once, and which of them each is."""
    shapes = {f: np.broadcast_to(v, (s.size, v.shape[1])) for f, v in e.shapes.items()}
    flat = [getattr(s, f) for f in ("a", "q", "c", "h", "d", "r", "m0", "p0")]
    _, first, of = np.unique(np.concatenate([x.reshape(s.size, -1) for x in (*flat, *shapes.values())], axis=1), axis=0, return_index=True, return_inverse=True)
    return System(*[x[first] for x in flat]), Emissions(e.families, {f: v[first] for f, v in shapes.items()}), of.reshape(-1)


class Composed:
    """A Kalman filter over the variables and channels that are normal and apart from the others, beside a mixed one over
    these; their likelihoods multiply. Systems that differ on one side only are one system on the other."""

    def __init__(self, system: System, emissions: Emissions, how: Settings, normal: Blocks):
        own, e, left = distinct(only(system, normal.latents, normal.channels), emissions.of(normal.channels))
        other, f, right = distinct(only(system, normal.others, normal.other_channels), emissions.of(normal.other_channels))
        kalman = Beside(own) if lockstep.Filter.serves(own) else Mixed(own, e, Settings())
        self.parts, self.which = [(normal.channels, kalman), (normal.other_channels, Mixed(other, f, within(how, normal.others)))], (left, right)
        self.steps = self

    def take(self, dt: np.ndarray) -> np.ndarray:
        return [part.steps.take(dt) for _, part in self.parts][0]

    @property
    def total(self) -> np.ndarray:
        return sum(part.total.reshape(-1, of.max() + 1)[:, of].ravel() for (_, part), of in zip(self.parts, self.which))

    def begin(self, keys) -> None:
        for _, part in self.parts:
            part.begin(keys)

    def move_rows(self, place: np.ndarray) -> None:
        for _, part in self.parts:
            part.move_rows(place)

    def see_rows(self, y: np.ndarray) -> None:
        for channels, part in self.parts:
            part.see_rows(y[:, channels])


@dataclass
class Blocks:
    """latents, channels: those for a Kalman filter; others, other_channels: the rest."""

    latents: list[int]
    channels: list[int]
    others: list[int]
    other_channels: list[int]


def blocks(effects: np.ndarray, loads: np.ndarray, families: list[str], df: list[float | None] | None = None) -> Blocks:
    """Which latent variables a Kalman filter can have for itself: those in components, joined by an effect, shared noise or a
    shared channel, of which every variable has normal noise and every channel is normal. effects: (n, n), true where one may
    have an effect on or noise in common with the other; loads: (channels, n), true where a channel may read a variable. A
    channel that reads none goes to the others."""
    n = len(effects)
    reach = effects | effects.T | np.eye(n, dtype=bool) | ((loads.T.astype(int) @ loads.astype(int)) > 0)
    while ((more := (reach.astype(int) @ reach.astype(int)) > 0) != reach).any():
        reach = more
    odd = np.array([d is not None for d in df or [None] * n])
    for j, family in enumerate(families):
        if family != "gaussian":
            odd |= loads[j]
    normal = ~(reach & odd).any(axis=1)
    apart = [j for j in range(len(loads)) if loads[j].any() and not (loads[j] & ~normal).any()]
    return Blocks(np.flatnonzero(normal).tolist(), apart, np.flatnonzero(~normal).tolist(), [j for j in range(len(loads)) if j not in apart])


def only(s: System, latents: list[int], channels: list[int]) -> System:
    x, y = np.array(latents, int), np.array(channels, int)
    square = lambda v, i: v[:, i[:, None], i]
    return System(square(s.a, x), square(s.q, x), s.c[:, x], s.h[:, y[:, None], x], s.d[:, y], square(s.r, y), s.m0[:, x], square(s.p0, x))


def within(how: Settings, latents: list[int]) -> Settings:
    df = None if how.df is None else [how.df[i] for i in latents]
    return Settings(how.points, how.rule, how.particles, how.exact, [latents.index(i) for i in how.sampled if i in latents], df, how.seed)


def backend(families: list[str], split: Blocks, df: list[float | None] | None = None) -> str:
    """Which likelihood serves: kalman if everything is normal, composed if some of it is and stands apart, else mixed."""
    normal = all(f == "gaussian" for f in families) and not any(df or [])
    return "kalman" if normal else "composed" if split.latents and split.channels else "mixed"


def _walk(sent, kind: type, how: Settings, size: int, key: str, time: str, ys: list[str]):
    rows = max(1, POINTS // (size * how.particles * how.points))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            f = kind(*sent.value)
            for chunk in lockstep.chunks(frames, key, time, ys, min(rows, lockstep.MOST), whole=True):
                place = f.steps.take(chunk.dt)
                f.begin(chunk.keys)
                for j, at in enumerate(chunk.rows()):
                    if j:
                        f.move_rows(place[at])
                    f.see_rows(chunk.y[at])
                yield of_series(key, chunk.keys, chunk.sizes, f.total.reshape(-1, size).T)

    return run


def passed(panel: DataFrame, kind: type, args: tuple, key: str, time: str, ys: list[str], totals: bool = False) -> DataFrame:
    """(key, system, n, loglik) from one walk over the sorted panel with a filter of the given kind; args: what it is made of,
    systems first, settings third. totals: (system, loglik) to be added up."""
    run = _walk(panel.sparkSession.sparkContext.broadcast(args), kind, args[2], args[0].size, key, time, ys)
    if totals:
        return summed(panel, run, args[0].size)
    return panel.mapInPandas(run, f"{key} {dict(panel.dtypes)[key]}, system int, n long, loglik double")


def rb_loglik(panel: DataFrame, system: System, emissions: Emissions, key: str, time: str, ys: list[str], how: Settings | None = None, totals: bool = False) -> DataFrame:
    """(key, system, n, loglik) of series with channels of any family. panel: from sort_panel. With the settings as they are
    nothing is drawn: the normal state that has the right moments after each observation goes on to the next. Missing
    channels are left out; rows of equal time follow each other without dynamics."""
    return passed(panel, Mixed, (system, emissions, how or Settings()), key, time, ys, totals)


def composed_loglik(panel: DataFrame, system: System, emissions: Emissions, split: Blocks, key: str, time: str, ys: list[str], how: Settings | None = None, totals: bool = False) -> DataFrame:
    """(key, system, n, loglik): two filters over the two sides of `split` in one walk."""
    return passed(panel, Composed, (system, emissions, how or Settings(), split), key, time, ys, totals)


def particle_loglik(panel: DataFrame, system: System, family: list[str], key: str, time: str, ys: list[str], particles: int = 200, seed: int = 0, df: list[float | None] | None = None) -> DataFrame:
    """(key, system, n, loglik): bootstrap particle filter, in which every latent variable is drawn. df: of Student's t noise of
    latent variables."""
    n = system.a.shape[-1]
    return rb_loglik(panel, system, Emissions(family), key, time, ys, Settings(points=1, particles=particles, sampled=list(range(n)), df=df, seed=seed))
