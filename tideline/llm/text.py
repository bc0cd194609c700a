"""Words of whole texts as Arrow and numpy arrays: the step that most text operators share.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All functions take one record batch inside a task;
`pieces` keeps what is unpacked at a time small however long the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 6 << 20


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `limit` bytes together (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Words:
    """codes: per word its index in vocab, text after text; offsets: text i has codes[offsets[i]:offsets[i + 1]]."""

    codes: np.ndarray
    offsets: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """Per word the index of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Words of each text; a null text has none. lower: A-Z only."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = flat.filter(full).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), kept[offsets], coded.dictionary)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values (first axis) over each run offsets[i]:offsets[i + 1]; zero for an empty run."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def grouped(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values (whole numbers from 0 on) of each row, how often each occurs, and where the rows' runs begin."""
    unit = int(value.max(initial=0)) + 1
    both, times = np.unique(row * unit + value, return_counts=True)
    return both % unit, times, np.searchsorted(both, np.arange(rows + 1) * unit)


def packed(value: np.ndarray, times: np.ndarray, starts: np.ndarray, bits: int) -> list[bytes]:
    """Rows of `grouped` values as 32-bit entries: a value in the lower `bits`, and how often it occurs in the others (over
    several entries if need be)."""
    most = (1 << (32 - bits)) - 1
    copies = -(-times // most)
    value, left = np.repeat(value, copies), np.repeat(times, copies)
    at = np.arange(len(value)) - np.repeat(np.cumsum(copies) - copies, copies)
    entry = (value | np.minimum(left - at * most, most) << bits).astype("<u4")
    starts = np.append(0, np.cumsum(copies))[starts]
    return [entry[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def unpacked(rows: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and times of `packed` rows one after another, and where the rows' runs begin."""
    raw = rows.to_pylist()
    entry = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
    return entry & ((1 << bits) - 1), entry >> bits, np.append(0, np.cumsum(np.array([len(x) // 4 for x in raw], np.int64)))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def thin(df: DataFrame, by: list[str], key: str, rows: int, seed: int = 7) -> DataFrame:
    """About `rows` rows of each group in expectation, or all of a smaller group: a row is taken by the hash of its key,
    so the choice is the same on every run and needs no sort. `by` columns must have few values."""
    total = df.groupBy(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)]).agg(F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("_n"))
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return df.join(F.broadcast(total), same).where(spot < share).select(*df.columns)
