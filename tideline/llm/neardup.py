"""SimHash near-duplicates by the generalised pigeonhole principle.

Distinct fingerprints are compared, not documents. Bits that go together are put into one partition; each partition gets
its own threshold, and the thresholds sum to radius - partitions + 1, so that two fingerprints within the radius agree up
to the threshold in some partition. The number of partitions and the thresholds come from dynamic programming over
candidate counts estimated from all fingerprints. Every fingerprint is stored under its value in each partition and
looks up the values within that partition's threshold; what meets in a bucket is compared, and a bucket hands on a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import graph
from tideline.llm.spark_io import cut, sendable, tidied

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints that one bucket compares in a task; a larger bucket is linked by shared midpoints instead.
BUCKET = 50_000


def shingle_hashes(content: str | None, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each run of `shingle` blank-joined words, A-Z lower-cased; of the whole sequence if it is shorter."""
    ws = (content or "").encode("utf-8").lower().split()
    if not ws:
        return []
    joined = b" ".join(ws)
    if len(ws) <= shingle:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.array([len(w) + 1 for w in ws])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], seed) for a, b in zip([0, *ends[:-shingle]], ends[shingle - 1 :])]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document (counts[i] hashes each, one after another) the bits set in over half of its hashes.

    Eight bits are counted at once in the byte lanes of 64-bit words, over runs of at most 255 hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    ends = np.cumsum(counts)[full]
    sizes = counts[full]
    runs = -(-sizes // 255)
    owner = np.repeat(np.arange(len(full)), runs)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    starts = np.repeat(ends - sizes, runs) + 255 * (np.arange(len(owner)) - np.repeat(first, runs))
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        per_run = np.add.reduceat((hashes >> np.uint64(k)) & lanes, starts)
        seen = np.add.reduceat(per_run.view(np.uint8).reshape(-1, 8).astype(np.int64), first)
        for lane in range(8):
            out[full] |= (2 * seen[:, lane] > sizes).astype(np.uint64) << np.uint64(8 * lane + k)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp as a signed long; zero for texts without words, null ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, held, counts, size = [], [], [], 0
            for content in batch.column("text").to_pylist():
                h = shingle_hashes(content, shingle, seed)
                held.append(np.array(h, np.uint64))
                counts.append(len(h))
                size += len(h)
                if size > 1 << 20:
                    fps.append(majority(np.concatenate(held), np.array(counts)))
                    held, counts, size = [], [], 0
            if counts:
                fps.append(majority(np.concatenate(held), np.array(counts)))
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id bigint, fp bigint")


def bit_moments(fps: DataFrame) -> tuple[float, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set: 64 x 64, summed over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            n += len(bits)
            both += bits.T @ bits
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(both[i, j], float(n)))], names=["i", "j", "c"]
        )

    rows = fps.select("fp").mapInArrow(tidied(run), "i bigint, j bigint, c double").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    both, n = np.zeros((BITS, BITS)), 0.0
    for r in rows:
        if r.i < 0:
            n = r.c
        else:
            both[r.i, r.j] = r.c
    return n, both


def group_bits(n: float, both: np.ndarray, parts: int) -> list[list[int]]:
    """All bits in `parts` groups of nearly equal size, correlated bits together: a group starts with the bit that has
    most correlation left and takes in the one most correlated with it until it is full."""
    f = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(f, f)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    cor = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(cor, 0)
    left, groups = list(range(BITS)), []
    for g in range(parts):
        size = len(left) // (parts - g)
        group = [max(left, key=lambda b: cor[b, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            b = max(left, key=lambda b: cor[b, group].sum())
            group.append(b)
            left.remove(b)
        groups.append(sorted(group))
    return groups


def within(disagree: np.ndarray, most: int) -> list[float]:
    """Chance that at most 0, 1, ... `most` of independent bits differ."""
    p = np.zeros(most + 1)
    p[0] = 1
    for d in disagree:
        p[1:] = p[1:] * (1 - d) + p[:-1] * d
        p[0] *= 1 - d
    return np.cumsum(p).tolist()


def plan(n: float, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions with thresholds (-1: not used). For each number of partitions, dynamic programming spreads
    radius - partitions + 1 over them at the least estimated cost: rows to store and look up plus candidates to compare."""
    f = np.diag(both) / max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, radius + 2):
        groups = group_bits(n, both, parts)
        cost = []
        for g in groups:
            near = within(2 * f[g] * (1 - f[g]), radius)
            cost.append([0.0] + [n * sum(comb(len(g), k) for k in range(t + 1)) + 0.05 * n * n * near[t] for t in range(radius + 1)])
        total = radius - parts + 1
        table = {0: (0.0, [])}
        for c in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (sofar, chosen) in table.items():
                for t in range(-1, radius + 1):
                    new = sofar + c[t + 1], [*chosen, t]
                    if spent + t not in step or new[0] < step[spent + t][0]:
                        step[spent + t] = new
            table = step
        value, chosen = table[total]
        if best is None or value < best[0]:
            best = value, list(zip(groups, chosen))
    return best[1]


def masks(bits: list[int], most: int) -> np.ndarray:
    """Every change of at most `most` of the bits, the unchanged one first."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(bits, k)], np.uint64)


def lookups(fps: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp): each fingerprint under its own value and those it looks up."""
    used = [(k, np.uint64(sum(1 << b for b in bits)), masks(bits, t)) for k, (bits, t) in enumerate(partitions) if t >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, own, changes in used:
                for at in range(0, len(fp), step := max(1, (1 << 18) // len(changes))):
                    some = fp[at : at + step]
                    value = ((some & own)[:, None] ^ changes[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(value), k, np.int32)), pa.array(value.view(np.int64)), pa.array(np.repeat(some, len(changes)).view(np.int64))],
                        names=["part", "value", "fp"],
                    )

    return fps.select("fp").mapInArrow(tidied(run), "part int, value bigint, fp bigint")


def forest(nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius that join what is joined at all: each node reached takes its unreached neighbours."""
    rest, a, b = nodes, [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (nodes[:0], nodes[:0])


def links(fps: DataFrame, partitions: list[tuple[list[int], int]], radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect whatever is within the radius."""
    met = lookups(fps, partitions).repartition("part", "value").sortWithinPartitions("part", "value")

    def small(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of neighbouring rows with one key, at a distance of 1, 2, ... rows."""
        a, b = [], []
        live = np.arange(len(fp))
        for step in itertools.count(1):
            live = live[live + step < len(fp)]
            live = live[(key[live] == key[live + step])]
            if not len(live):
                break
            hit = live[np.bitwise_count(fp[live] ^ fp[live + step]) <= radius]
            a.append(fp[hit])
            b.append(fp[hit + step])
        return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])

    def out(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
        if kind == 0 and len(a):
            pair = np.unique(np.stack([a, b]), axis=1)
            a, b = np.ascontiguousarray(pair[0]), np.ascontiguousarray(pair[1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key0, kept, over = None, np.zeros(0, np.uint64), False  # of the bucket that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
            value = batch.column("value").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            new = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (value[1:] != value[:-1])))
            ends = np.append(new[1:], len(fp))
            single_k, single_f = [], []
            for n, (s, e) in enumerate(zip(new.tolist(), ends.tolist())):
                key = (part[s], value[s])
                if key != key0:
                    if not over and len(kept) > 1:
                        yield out(*forest(np.unique(kept), radius), 0)
                    key0, kept, over = key, np.zeros(0, np.uint64), False
                last = n == len(new) - 1
                if not last and not over and not len(kept) and e - s <= 40:
                    if e - s > 1:
                        single_k.append(np.full(e - s, n))
                        single_f.append(fp[s:e])
                    continue
                kept = np.concatenate([kept, fp[s:e]])
                if len(kept) > bucket:
                    over = True
                if over:
                    yield out(kept, kept, 1)
                    kept = kept[:0]
            if single_k:
                yield out(*small(np.concatenate(single_k), np.concatenate(single_f)), 0)
        if not over and len(kept) > 1:
            yield out(*forest(np.unique(kept), radius), 0)

    found = cut(met.mapInArrow(tidied(run), "kind int, a bigint, b bigint").distinct())
    direct = found.where("kind = 0").select("a", "b")
    crowded = found.where("kind = 1").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return direct
    return direct.unionByName(midpoint_links(crowded, radius))


def midpoint_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links through values halfway: two fingerprints are within an even radius exactly if some value is within half
    of it of both. Rows grow with the fingerprints, not with their pairs."""
    if radius % 2:
        raise ValueError(f"a radius of {radius} bits: linking by midpoints needs an even one")
    half = masks(list(range(BITS)), radius // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 128):
                some = fp[at : at + 128]
                value = (some[:, None] ^ half[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.repeat(some, len(half)).view(np.int64))], names=["value", "fp"])

    near = fps.mapInArrow(tidied(run), "value bigint, fp bigint")
    low = near.groupBy("value").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    return near.join(low, "value").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def cluster(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over
    links of at most `radius` differing bits (null where every doc_id of the component is null).

    Rows with equal text, doc_id or both stay; texts without words (empty or null ones too) have fingerprint zero and are
    linked like any other. Columns other than doc_id and text are not read."""
    own = cut(fingerprints(docs, shingle, seed))
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("low")))
    n, both = bit_moments(classes)
    found = links(classes, plan(n, both, radius), radius, bucket)
    return labelled(own, classes, graph.components(found))


def labelled(own: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of own's rows, from the classes' smallest doc_ids and the roots of linked ones."""
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = rooted.join(lowest, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(labels, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, clusters: Callable[..., DataFrame] = cluster, mark: Callable[[DataFrame], DataFrame] = fingerprints, **how) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays, with all its columns. Of
    rows that share that doc_id one stays; a component without any doc_id keeps one row of each fingerprint. Null and empty
    texts are one group. Rows that stay are not shuffled as long as the ids to drop are few enough to be sent.

    clusters and mark give components and fingerprints: those of this module, or of `similar`."""
    names, docs = docs.columns, docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])
    found = cut(clusters(docs, **how))
    ids = found.groupBy("doc_id").agg(F.count("*").alias("_n"), F.max(F.col("doc_id") == F.col("component_id")).alias("_first"))
    ids = cut(ids.where("doc_id is not null and not (_n = 1 and _first)"))
    once = docs.where("doc_id is not null").join(sendable(ids.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    odd = found.join(ids.where("_n > 1").select("doc_id"), "doc_id", "left_semi").unionByName(found.where("doc_id is null"))
    if odd.isEmpty():
        return once.toDF(*names)
    repeated = docs.join(ids.where("_n > 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    rest = repeated.unionByName(docs.where("doc_id is null")).withColumn("_h", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("")))).dropDuplicates(["_h"])
    marks = mark(rest.select(F.col("_h").alias("doc_id"), "text")).select(F.col("doc_id").alias("_h"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))
    own = rest.select("_h", F.col("doc_id").alias("_id")).join(marks, "_h")
    heads = odd.where("component_id is null or doc_id = component_id").distinct()
    heads = heads.select(F.col("doc_id").alias("_head"), F.col("fingerprint").alias("_fp"), F.coalesce(F.col("component_id").cast("string"), "fingerprint").alias("_group"))
    same = F.col("_id").eqNullSafe(F.col("_head")) & (F.col("fingerprint") == F.col("_fp"))
    chosen = own.join(heads, same).groupBy("_group").agg(F.min("_h").alias("_h")).select("_h")
    return once.unionByName(rest.join(chosen, "_h", "left_semi").select(*docs.columns)).toDF(*names)
