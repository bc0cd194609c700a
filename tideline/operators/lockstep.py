"""Many series side by side: a task takes some rows, and all series among them go on by one row at a time.

Arrays end in (systems, series). Series stand in order of falling length, so that those which still have a row come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import linear

if TYPE_CHECKING:
    from tideline.operators.statespace import System

#: Rows times systems that a task takes at once, and rows at most.
CELLS, MOST = 1 << 18, 1 << 16
#: Rows of a panel that are packed into one.
PACKED = 4096
#: Positions whose states are kept for a walk back.
BLOCK = 256


def rows_at_once(systems: int) -> int:
    return max(1, min(MOST, CELLS // max(systems, 1)))


@dataclass
class Chunk:
    """keys, starts, sizes: of the runs of rows of one series, the longest first; dt: days since the row before, zero for a
    series' first; time, y: of all rows. goes_on: the place of the run that goes on with the last series of the chunk before, and
    last: of the one that may go on in the next chunk."""

    keys: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    dt: np.ndarray
    time: np.ndarray
    y: np.ndarray
    goes_on: int | None
    last: int

    def rows(self) -> Iterator[np.ndarray]:
        """Rows of each position: of the first series, as many as have one."""
        alive = len(self.sizes) - np.searchsorted(self.sizes[::-1], np.arange(self.sizes[0]), side="right")
        for j, n in enumerate(alive.tolist()):
            yield self.starts[:n] + j


def packed(panel: DataFrame, key: str, time: str, ys: list[str]) -> DataFrame:
    """A sorted panel for many passes: each row holds PACKED of its rows, as the keys and sizes of their runs and as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i in range(0, len(frame), PACKED):
                part = frame.iloc[i : i + PACKED]
                k = part[key].to_numpy()
                starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                out.append((k[starts].tolist(), np.diff(np.append(starts, len(k))).astype("<i4").tobytes(), part[time].to_numpy("<f8").tobytes(), part[ys].to_numpy("<f8").tobytes()))
            yield pd.DataFrame(out, columns=["_keys", "_sizes", "_time", "_y"])

    columns = panel.select(key, F.col(time).cast("double").alias(time), *[F.col(y).cast("double").alias(y) for y in ys])
    return columns.mapInPandas(run, f"_keys array<{dict(panel.dtypes)[key]}>, _sizes binary, _time binary, _y binary")


def taken(frames: Iterator[pd.DataFrame], key: str, time: str, ys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, times, observations) of a panel, packed or not."""
    for frame in frames:
        if "_keys" in frame:
            for keys, sizes, t, y in zip(frame["_keys"], frame["_sizes"], frame["_time"], frame["_y"]):
                t = np.frombuffer(t, "<f8")
                yield np.repeat(np.asarray(keys), np.frombuffer(sizes, "<i4")), t, np.frombuffer(y, "<f8").reshape(len(t), len(ys))
        elif len(frame):
            yield frame[key].to_numpy(), frame[time].to_numpy(float), frame[ys].to_numpy(float)


def chunks(frames: Iterator[pd.DataFrame], key: str, time: str, ys: list[str], rows: int, whole: bool) -> Iterator[Chunk]:
    """Chunks of about `rows` rows of a sorted panel. whole: no series is cut in two; one of more rows is a chunk of its own."""
    held: list[tuple] = []
    tail: tuple | None = None

    def made(k: np.ndarray, t: np.ndarray, y: np.ndarray) -> Chunk:
        nonlocal tail
        new = np.append(True, k[1:] != k[:-1])
        dt = np.where(new, 0.0, np.diff(t, prepend=t[0]))
        goes_on = tail is not None and bool(tail[0] == k[0])
        if goes_on:
            dt[0] = t[0] - tail[1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(k)))
        order = np.argsort(-sizes, kind="stable")
        tail = None if whole else (k[-1], t[-1])
        place = np.argsort(order)
        return Chunk(k[starts[order]], starts[order], sizes[order], np.where(dt > 0, dt, 0.0), t, y, int(place[0]) if goes_on else None, int(place[-1]))

    def joined() -> tuple:
        return tuple(np.concatenate(x) for x in zip(*held)) if len(held) > 1 else held[0]

    n, wanted = 0, rows
    for part in taken(frames, key, time, ys):
        held.append(part)
        n += len(part[0])
        while n >= wanted:
            k, t, y = held[0] if len(held) == 1 else joined()
            at = rows
            if whole:
                starts = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), n)
                # the last series may have more rows to come
                fits = starts[(starts > 0) & (starts < n)]
                if not len(fits):
                    held, wanted = [(k, t, y)], 2 * n
                    break
                at = int(fits[max(np.searchsorted(fits, rows, side="right") - 1, 0)])
            yield made(k[:at], t[:at], y[:at])
            held, n, wanted = [(k[at:], t[at:], y[at:])] if at < n else [], n - at, rows
    if n:
        yield made(*joined())


class Steps:
    """Transition, noise and shift of each interval, for all systems."""

    def __init__(self, s: System):
        self.s, self.values, self.table = s, np.zeros(0), ()

    def take(self, dt: np.ndarray) -> np.ndarray:
        """Makes the table of these intervals, zero among them, and gives the place of each in it."""
        values = np.unique(np.append(dt, 0.0))
        if not np.isin(values, self.values).all():
            self.values = values
            if len(values) > 1:
                ad, qd, cd = linear.discretize(self.s.a, self.s.q, self.s.c, values[:, None, None, None])
                self.table = tuple(np.ascontiguousarray(np.moveaxis(x, (0, 1), (-1, -2))) for x in (ad, qd, cd.reshape(len(values), *self.s.c.shape)))
        return np.searchsorted(self.values, dt)

    def of(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        if (at == at[0]).all():
            return tuple(x[..., at[:1]] for x in self.table)
        return tuple(x.take(at, axis=-1) for x in self.table)


def predicted(step: tuple, m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ad, qd, cd = step
    if len(m) == 1:
        return ad[0] * m + cd, ad * ad * p + qd
    m = np.einsum("ij...,j...->i...", ad, m) + cd
    return m, np.einsum("ik...,lk...->il...", np.einsum("ij...,jk...->ik...", ad, p), ad) + qd


class Filter:
    """Kalman filters over the series of one chunk after another. Noise of channels is apart from each other's, so an
    observation's channels are taken in turn."""

    def __init__(self, s: System):
        self.s, self.steps = s, Steps(s)
        last = lambda x: np.ascontiguousarray(np.moveaxis(x, 0, -1))
        self.h, self.d, self.m0, self.p0 = (last(x)[..., None] for x in (s.h, s.d, s.m0, s.p0))
        self.r = last(np.diagonal(s.r, axis1=1, axis2=2))[..., None]

    @staticmethod
    def serves(s: System) -> bool:
        return not (s.r * (1 - np.eye(s.r.shape[-1]))).any()

    def begin(self, n: int) -> None:
        self.m = np.repeat(self.m0, n, axis=-1)
        self.p = np.repeat(self.p0, n, axis=-1)
        self.total = np.zeros((self.s.size, n))

    def forward(self, y: np.ndarray, step: tuple | None, tape: list | None = None) -> None:
        """One row of the first series, as many as y has."""
        n = len(y)
        m, p = self.m[..., :n], self.p[..., :n]
        if step is not None:
            before = m.copy() if tape is not None else None, p.copy() if tape is not None else None
            m[:], p[:] = predicted(step, m, p)
        else:
            before = None
        seen = np.isfinite(y)
        marks = []
        for c in np.flatnonzero(seen.any(axis=0)).tolist():
            there = seen[:, c]
            at = None if there.all() else np.flatnonzero(there)
            mm, pp, v = (m, p, y[:, c]) if at is None else (m.take(at, axis=-1), p.take(at, axis=-1), y[at, c])
            h = self.h[c]
            if len(mm) == 1:
                ph = pp[0] * h
                s = h[0] * ph[0] + self.r[c]
                v = v - (h[0] * mm[0] + self.d[c])
            else:
                ph = np.einsum("ij...,j...->i...", pp, h)
                s = np.einsum("i...,i...->...", ph, h) + self.r[c]
                v = v - np.einsum("i...,i...->...", mm, h) - self.d[c]
            w, gain = v / s, ph / s
            if tape is not None:
                marks.append((c, at, mm.copy() if at is None else mm, pp.copy() if at is None else pp, ph, gain, s, w))
            ll = -0.5 * (np.log(2 * np.pi * s) + v * w)
            if at is None:
                m += ph * w
                p -= ph[:, None] * gain[None]
                self.total[:, :n] += ll
            else:
                m[..., at] = mm + ph * w
                p[..., at] = pp - ph[:, None] * gain[None]
                self.total[:, at] += ll
        if tape is not None:
            tape.append((before, step, marks))

    def walk(self, chunk: Chunk, state: tuple | None = None) -> None:
        """All rows of a chunk. state: (m, p, total) of the series that goes on."""
        place = self.steps.take(chunk.dt)
        self.begin(len(chunk.sizes))
        if chunk.goes_on is not None:
            self.m[..., chunk.goes_on], self.p[..., chunk.goes_on], self.total[:, chunk.goes_on] = state
        for j, rows in enumerate(chunk.rows()):
            at = place[rows]
            moves = (j or chunk.goes_on is not None) and at.any()
            self.forward(chunk.y[rows], self.steps.of(at) if moves else None)

    def state(self, i: int) -> tuple[np.ndarray, ...]:
        return self.m[..., i].copy(), self.p[..., i].copy(), self.total[:, i].copy()


class Slopes(Filter):
    """The same, and back: adds up slopes in h, d, r, m0, p0 and, by interval, in transitions, noise and shifts."""

    def __init__(self, s: System):
        super().__init__(s)
        self.to = {f: np.zeros(x.shape[:-1]) for f, x in (("h", self.h), ("d", self.d), ("r", self.r), ("m0", self.m0), ("p0", self.p0))}

    def both_ways(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(log-likelihood of each system, intervals, slopes in their forms with intervals as the last axis)."""
        place, rows = self.steps.take(chunk.dt), list(chunk.rows())
        self.begin(len(chunk.sizes))
        kept = []
        for j in range(0, len(rows), BLOCK):
            kept.append((self.m.copy(), self.p.copy()))
            tape = self.taped(chunk, rows, place, j)
        total = self.total.sum(axis=1)
        n, b = len(self.m), self.s.size
        sums = np.zeros((n, n, b, len(self.steps.values))), np.zeros((n, n, b, len(self.steps.values))), np.zeros((n, b, len(self.steps.values)))
        gm, gp = np.zeros_like(self.m), np.zeros_like(self.p)
        for k in reversed(range(len(kept))):
            if k < len(kept) - 1:
                self.m, self.p = kept[k]
                tape = self.taped(chunk, rows, place, k * BLOCK)
            for j in reversed(range(len(tape))):
                own = rows[k * BLOCK + j]
                self.back(tape[j], gm[..., : len(own)], gp[..., : len(own)], place[own], sums)
        self.to["m0"] += gm.sum(axis=-1)
        self.to["p0"] += gp.sum(axis=-1)
        return total, self.steps.values, sums

    def taped(self, chunk: Chunk, rows: list, place: np.ndarray, start: int) -> list:
        tape: list = []
        for j in range(start, min(start + BLOCK, len(rows))):
            at = place[rows[j]]
            self.forward(chunk.y[rows[j]], self.steps.of(at) if j and at.any() else None, tape)
        return tape

    def back(self, taped: tuple, gm: np.ndarray, gp: np.ndarray, place: np.ndarray, sums: tuple) -> None:
        before, step, marks = taped
        for c, at, m, p, ph, gain, s, w in reversed(marks):
            h = self.h[c]
            am, ap = (gm, gp) if at is None else (gm.take(at, axis=-1), gp.take(at, axis=-1))
            if len(m) == 1:
                gk = ap[0] * gain
                pull, quad = gain[0] * am[0], gain[0] * gk[0]
                pm, pk = p[0] * am, p[0] * gk
            else:
                gk = np.einsum("ij...,j...->i...", ap, gain)
                pull, quad = np.einsum("i...,i...->...", gain, am), np.einsum("i...,i...->...", gain, gk)
                pm, pk = np.einsum("ij...,j...->i...", p, am), np.einsum("ij...,j...->i...", p, gk)
            gs = 0.5 * (w * w - 1 / s) - pull * w + quad
            gv = pull - w
            self.to["h"][c] += (w * pm - 2 * pk + 2 * gs * ph - gv * m).sum(axis=-1)
            self.to["d"][c] -= gv.sum(axis=-1)
            self.to["r"][c] += gs.sum(axis=-1)
            turn = 0.5 * w * am - gk
            own = ap + turn[:, None] * h[None] + h[:, None] * turn[None] + (gs * h)[:, None] * h[None]
            if at is None:
                gm -= h * gv
                gp[:] = own
            else:
                gm[..., at] = am - h * gv
                gp[..., at] = own
        if step is None:
            return
        (m0, p0), (ad, _, _) = before, step
        if len(m0) == 1:
            ga = gm[None] * m0[None] + 2 * gp * ad * p0
        else:
            ga = gm[:, None] * m0[None] + 2 * np.einsum("ij...,jk...->ik...", np.einsum("ij...,jk...->ik...", gp, ad), p0)
        self.dealt(place, (ga, gp, gm), sums)
        if len(m0) == 1:
            gm[:], gp[:] = ad[0] * gm, ad * ad * gp
        else:
            gm[:] = np.einsum("ji...,j...->i...", ad, gm)
            gp[:] = np.einsum("ik...,kj...->ij...", np.einsum("ki...,kj...->ij...", ad, gp), ad)

    @staticmethod
    def dealt(place: np.ndarray, parts: tuple, sums: tuple) -> None:
        """Adds what belongs to each interval."""
        if (place == place[0]).all():
            for held, x in zip(sums, parts):
                held[..., place[0]] += x.sum(axis=-1)
            return
        order = np.argsort(place, kind="stable")
        at = place[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        for held, x in zip(sums, parts):
            held[..., at[first]] += np.add.reduceat(x.take(order, axis=-1), first, axis=-1)
