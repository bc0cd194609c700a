"""Compression of vectors to codes, with codebooks by Elkan's form of Lloyd's rounds.

Vectors become whole numbers and are cut into parts; each part has a codebook. A row keeps from round to round, for each
part, the entry it has, an upper bound of its distance to that entry and a lower bound of the distance to every entry. When
entries move, bounds are shifted by how far; by the triangle inequality most distances then need not be computed. An entry
is left out only where it is strictly farther; all others are compared as exact whole numbers, ties going to the lower index,
so codes do not depend on the bounds' precision.

Each round is one pass over the rows, written to the folder that the cluster shares, and one grouped sum of at most
parts x entries rows, which alone come to the driver. Lower bounds are kept as bytes, rounded down by a step of the row.

Vectors that are null or hold a null or a non-finite component take no part. Rows of equal id are ordered by their numbers
and count each; a null id comes after all others. With fewer rows than entries, a codebook has as many entries as there are
rows. An empty table gives an empty one. All vectors must have one length, which the parts divide, and components of at most
`largest` after scaling; anything else is an error. Vectors without components have entry 0 everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.spark_io import sendable, shared_folder

#: Components of differences that are in memory together, and what covers the rounding of a few float operations.
AT_ONCE, SLACK = 1 << 21, 1e-12


@dataclass
class Books:
    """Entries of each part before and after the last move: arrays (parts, entries, width) of whole numbers."""

    now: np.ndarray
    before: np.ndarray | None = None

    def joined(self) -> str:
        """All components by part, entry and position."""
        return ",".join(map(str, self.now.ravel().tolist()))


def largest(length: int) -> int:
    """Up to which components the squared distances of vectors, added up, are exact in 64 bits."""
    return isqrt((1 << 60) // max(length, 1))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most**2 < 1 << 53 else np.int64  # floats are as exact there, and faster
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def first(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, upper bound, lower bounds) of each row, all distances computed."""
    d = distances(x, entries)
    own = d.argmin(axis=1)
    least = d[np.arange(len(x)), own]
    return own, least, above(least), below(d)


def again(x: np.ndarray, entries: np.ndarray, before: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper bound, lower bounds, how many distances were computed) after the entries have moved. A row whose upper
    bound is under half the distance from its entry to any other stays without a look; the others compute the distance to
    their own entry and then to those that neither bound rules out."""
    moved = above(((entries - before) ** 2).sum(axis=1))
    between = below(distances(entries, entries))
    upper = (upper + moved[own]) * (1 + SLACK)
    lower = np.maximum(lower - moved - SLACK * (lower + moved), 0)
    others = between + np.where(np.eye(len(entries), dtype=bool), np.inf, 0)
    live = np.flatnonzero(~(upper < others.min(axis=1)[own] / 2))
    a = own[live]
    mine = ((x[live] - entries[a]) ** 2).sum(axis=1)
    upper[live], lower[live, a] = above(mine), below(mine)
    u = upper[live][:, None]
    open_ = ~((lower[live] > u) | (others[a] / 2 > u))
    open_[np.arange(len(live)), a] = False
    i, j = np.nonzero(open_)
    found = ((x[live[i]] - entries[j]) ** 2).sum(axis=1)
    lower[live[i], j] = below(found)
    table = np.full((len(live), len(entries)), np.iinfo(np.int64).max)
    table[np.arange(len(live)), a], table[i, j] = mine, found
    best = table.argmin(axis=1)  # the first of equal ones
    own, upper = own.copy(), upper
    own[live], upper[live] = best, above(table[np.arange(len(live)), best])
    return own, upper, lower, len(live) + len(i)


def packed(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds as bytes, rounded down to a multiple of the row's step."""
    step = np.nextafter((lower.max(axis=1, initial=0) / 255).astype(np.float32), np.float32(np.inf))
    return step, np.floor(lower / step.astype(np.float64)[:, None]).clip(0, 255).astype(np.uint8)


def unpacked(step: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return bounds * step.astype(np.float64)[:, None] * (1 - SLACK)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column."""
    width = rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _numbers(rows: pa.Array, parts: int, width: int) -> np.ndarray:
    """Rows of whole numbers, cut into parts."""
    return np.asarray(rows.flatten(), np.int64).reshape(len(rows), parts, width)


def _bytes(rows: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), np.uint8).reshape(len(rows), width)


def whole_numbers(vectors: DataFrame, column: str, scale: int) -> Column:
    return F.transform(column, lambda x: F.floor(x.cast("double") * scale))


def usable(column: str) -> Column:
    """Whether a vector is there, without nulls and infinities."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(column, fine), F.lit(False))


def _assigner(books, parts: int, width: int, others: int, fresh: bool, last: bool):
    """The pass of one round. Rows come as the kept columns, then x, and unless fresh own, upper, step and lower of the
    round before; they leave with those of this one, or with code and error after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = books.value
        k = b.now.shape[1]
        rows = max(1, AT_ONCE // (k * max(width, 1)))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                n = batch.num_rows
                x = _numbers(batch.column(others), parts, width)
                code, upper = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.float32)
                step, lower = np.zeros((n, parts), np.float32), np.zeros((n, parts, k), np.uint8)
                error = np.zeros(n, np.int64)
                if not fresh:
                    old = _bytes(batch.column(others + 1), parts * 2).view(np.uint16).reshape(n, parts).astype(np.int64)
                    old_upper, old_step = (_bytes(batch.column(others + c), parts * 4).view(np.float32).reshape(n, parts) for c in (2, 3))
                    old_lower = _bytes(batch.column(others + 4), parts * k).reshape(n, parts, k)
                for p in range(parts):
                    own_x = x[:, p]
                    if fresh:
                        own, _, up, low = first(own_x, b.now[p])
                    else:
                        own, up, low, _ = again(own_x, b.now[p], b.before[p], old[:, p], old_upper[:, p].astype(np.float64), unpacked(old_step[:, p], old_lower[:, p]))
                    code[:, p] = own
                    if last:
                        error += ((own_x - b.now[p][own]) ** 2).sum(axis=1)
                    else:
                        upper[:, p] = np.nextafter(up.astype(np.float32), np.float32(np.inf))
                        step[:, p], lower[:, p] = packed(low)
                kept = batch.columns[:others]
                narrow = _binary(code.astype("<u2").view(np.uint8).reshape(n, -1))
                if last:
                    yield pa.RecordBatch.from_arrays([*kept, narrow, pa.array(error)], names=[*batch.schema.names[:others], "own", "error"])
                else:
                    state = [narrow, _binary(upper.view(np.uint8).reshape(n, -1)), _binary(step.view(np.uint8).reshape(n, -1)), _binary(lower.reshape(n, -1))]
                    yield pa.RecordBatch.from_arrays([*kept, batch.column(others), *state], names=[*batch.schema.names[:others], "x", "own", "upper", "step", "lower"])

    return run


def _adder(parts: int, width: int, k: int):
    """Counts and sums of the parts that have an entry, one row for each entry met in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            x = _numbers(batch.column(0), parts, width)
            own = _bytes(batch.column(1), parts * 2).view(np.uint16).reshape(batch.num_rows, parts).astype(np.int64)
            slot = own + np.arange(parts) * k
            np.add.at(total, slot.ravel(), x.reshape(slot.size, width))
            many += np.bincount(slot.ravel(), minlength=parts * k)
        met = np.flatnonzero(many)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1, dtype=np.int32) * width), pa.array(total[met].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(many[met]), sums], names=["slot", "many", "sums"])

    return run


def _moved(state: DataFrame, books: Books) -> Books:
    """Each entry at the floor of the mean of its parts; one that no part has stays."""
    parts, k, width = books.now.shape
    part = state.select("x", "own").mapInArrow(_adder(parts, width, k), "slot bigint, many bigint, sums array<bigint>")
    sums = [F.sum(F.col("sums")[i]) for i in range(width)]
    rows = part.groupBy("slot").agg(F.sum("many").alias("many"), F.array(*sums).cast("array<bigint>").alias("sums")).collect()  # one row an entry
    now = books.now.reshape(parts * k, width).copy()
    for r in rows:
        now[r.slot] = [s // r.many for s in r.sums]
    return Books(now.reshape(parts, k, width), books.now)


@dataclass
class Coded:
    """rows: the kept columns of the input with own (two bytes a part) and error; books: the final entries."""

    rows: DataFrame
    books: Books


def compress(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Coded:
    """Codes of all usable vectors, with all columns of the input but the vector. Kept columns are renamed on the way, so
    theirs may have any name."""
    spark = vectors.sparkSession
    kept = [c for c in vectors.columns if c != column]
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    rows = vectors.where(usable(f"`{column}`")).select(*named, whole_numbers(vectors, f"`{column}`", scale).alias("x"))
    key = f"c{kept.index(id_col)}"
    start = [r.x for r in rows.orderBy(F.col(key).asc_nulls_last(), "x").select("x").limit(entries).collect()]  # at most `entries` rows
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes[:-1])
    new = (", " if kept else "") + "own binary, error bigint"
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(kept)]
    if not start:
        return Coded(rows.where("false").select(*back, F.lit(None).cast("binary").alias("own"), F.lit(None).cast("bigint").alias("error")), Books(np.zeros((parts, 0, 0), np.int64)))
    length = len(start[0])
    if any(len(x) != length for x in start):
        raise ValueError("vectors differ in length")
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    width = length // parts
    odd = (F.size("x") != length) | F.exists("x", lambda v: F.abs(v) > largest(length))
    rows = rows.where(F.when(odd, F.raise_error(F.lit("vectors differ in length or hold a component out of range")).cast("boolean")).otherwise(True))
    books = Books(np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy())
    with shared_folder(spark) as folder:
        state = rows
        for n in range(rounds + 1):
            run = _assigner(spark.sparkContext.broadcast(books), parts, width, len(kept), n == 0, n == rounds)
            fields = schema + (new if n == rounds else (", " if kept else "") + "x array<bigint>, own binary, upper binary, step binary, lower binary")
            state = folder.written(state.mapInArrow(run, fields), f"round{n}")
            if n < rounds:
                books = _moved(state, books)
            if n:
                folder.drop(f"round{n - 1}")
    return Coded(state.select(*back, "own", "error"), books)


def code(own: Column, parts: int = 4) -> Column:
    """Indexes of up to 256 entries, in the order of parts, as two hexadecimal digits each."""
    return F.lower(F.concat(*[F.hex(F.substring(own, 2 * p + 1, 1)) for p in range(parts)]))


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the errors of its label added up, nulls together) and the hash of all entries."""
    coded = compress(vectors.select("vec_id", "label", "embedding"))
    rows = coded.rows
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    entries = hashlib.sha256(coded.books.joined().encode()).hexdigest()
    return rows.join(sendable(by_label), F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", code(F.col("own")).alias("code"), "error", "label_error", F.lit(entries).alias("codebooks_sha256")
    )


__all__ = ["Books", "Coded", "code", "compress", "digest"]
