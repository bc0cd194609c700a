"""Exact top-k inner products by branch and bound over ball trees.

Vectors are dealt to shards of bounded size; a task builds a ball tree for each shard. Every query visits the leaves of a
tree in the order of the largest inner product that their balls allow, and stops at the first one below its k-th best
score so far. That score is shared: it starts from a sample that all tasks know and goes on from shard to shard.
Queries come in blocks of bounded size, each block against all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.spark_io import cut

SHARD, LEAF, QUERY_BLOCK, SAMPLE = 8192, 64, 4096, 1024
#: Integers from here on are not multiplied as floating-point numbers.
EXACT = float(1 << 53)


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows with an id and a vector without nulls, NaN or infinities."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col("vec_id").isNotNull())


def quantised(flat: np.ndarray, scale: float = 256.0) -> np.ndarray:
    """floor(scale * x) in double precision; an error where that is beyond 2^53, since it would not be exact."""
    out = np.floor(scale * flat.astype(np.float64))
    if len(out) and np.abs(out).max() > EXACT:
        raise ValueError(f"a component of {flat[np.abs(out).argmax()]} is too large for exact scores")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, as exact integers (within a long)."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * np.abs(a).max() * np.abs(b).max() < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Tree:
    """A ball for each node; leaves hold order[first:last]. Children come after their parent."""

    points: np.ndarray
    ids: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    span: np.ndarray


def grow(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halves the points along the line through two far ones until a leaf has at most `leaf` of them."""
    order = np.arange(len(points))
    centre, radius, child, span = [], [], [], []
    todo = [(0, len(points), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        own = points[order[a:b]]
        mid = own.mean(axis=0)
        apart = ((own - mid) ** 2).sum(axis=1)
        me = len(centre)
        centre.append(mid)
        radius.append(np.sqrt(apart.max()))
        child.append([-1, -1])
        span.append((a, b))
        if parent >= 0:
            child[parent][side] = me
        if b - a > leaf and apart.max() > 0:
            far = own[apart.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            order[a:b] = order[a:b][np.argsort(own @ (other - far), kind="stable")]
            half = (a + b) // 2
            todo += [(a, half, me, 0), (half, b, me, 1)]
    return Tree(points[order], ids[order], np.array(centre), np.array(radius), np.array(child), np.array(span))


class Best:
    """The k best (score, vec_id) of each query of a block, seeded with scores known to be reached."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.points, self.k = ids, points, k
        self.floor = floor.copy()
        self.held: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.length = np.sqrt((points**2).sum(axis=1))

    def bounds(self, queries: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
        """Largest product that a point of the ball can have, rounded up."""
        dot = self.points[queries] @ centre
        reach = self.length[queries] * radius
        return dot + reach + 1e-9 * (np.abs(dot) + reach + self.length[queries] * np.sqrt((centre**2).sum())) + 1e-6

    def offer(self, queries: np.ndarray, points: np.ndarray, ids: np.ndarray) -> None:
        scores = products(self.points[queries], points)
        scores_of = np.where(ids[None, :] == self.ids[queries][:, None], np.iinfo(np.int64).min, scores)
        for row in np.flatnonzero((scores_of >= self.floor[queries][:, None]).any(axis=1)):
            q = queries[row]
            heap = self.held[q]
            good = np.flatnonzero((scores_of[row] >= self.floor[q]) & (ids != self.ids[q]))
            for s, i in zip(scores[row][good].tolist(), ids[good].tolist()):
                if len(heap) < self.k:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
            if len(heap) == self.k:
                self.floor[q] = max(self.floor[q], float(heap[0][0]))

    def search(self, tree: Tree) -> None:
        found_q, found_leaf, found_bound = [], [], []
        everyone = np.arange(len(self.ids))
        frontier = [(0, everyone, self.bounds(everyone, tree.centre[0], tree.radius[0]))]
        while frontier:
            node, queries, bound = frontier.pop()
            live = bound >= self.floor[queries]
            queries, bound = queries[live], bound[live]
            if not len(queries):
                continue
            if tree.child[node][0] < 0:
                found_q.append(queries)
                found_leaf.append(np.full(len(queries), node))
                found_bound.append(bound)
                continue
            for c in tree.child[node]:
                frontier.append((c, queries, np.minimum(bound, self.bounds(queries, tree.centre[c], tree.radius[c]))))
        if not found_q:
            return
        q, leaf, bound = np.concatenate(found_q), np.concatenate(found_leaf), np.concatenate(found_bound)
        order = np.lexsort((-bound, q))
        q, leaf, bound = q[order], leaf[order], bound[order]
        new = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        turn = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q))))
        by_turn = np.argsort(turn, kind="stable")
        starts = np.searchsorted(turn[by_turn], np.arange(turn.max() + 2))
        for a, b in zip(starts[:-1], starts[1:]):
            now = by_turn[a:b]
            now = now[bound[now] >= self.floor[q[now]]]
            now = now[np.argsort(leaf[now], kind="stable")]
            cuts = np.flatnonzero(np.append(True, leaf[now][1:] != leaf[now][:-1])) if len(now) else []
            for s, e in zip(cuts, [*cuts[1:], len(now)]):
                first, last = tree.span[leaf[now[s]]]
                self.offer(q[now[s:e]], tree.points[first:last], tree.ids[first:last])


def _arrays(table: pa.Table | pa.RecordBatch, column: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and quantised vectors by vector length."""
    lists = table.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ids = table.column("vec_id").to_numpy() if isinstance(table, pa.Table) else table.column("vec_id").to_numpy(zero_copy_only=False)
    offsets = np.asarray(lists.offsets, np.int64)
    flat = quantised(lists.values.to_numpy(zero_copy_only=False))
    size = np.diff(offsets)
    out = {}
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out[int(d)] = ids[rows], flat[offsets[rows][:, None] + np.arange(d)[None, :]]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, column: str = "embedding", shard: int = SHARD, block: int = QUERY_BLOCK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows with the highest inner product for each query row: all other rows, if
    fewer; ties go to the smaller vec_id. Components are taken as floor(256 * x).

    Rows without vec_id, and vectors that are null or hold null, NaN or infinite components, take no part. Vectors are
    compared with those of their own length. A query row that occurs again with its vec_id counts once for each distinct
    vector; no row is compared with rows of its own vec_id, and other repeated rows stay. An empty table gives no rows.
    Components beyond 2^53 / 256 fail the job; scores must fit a long."""
    rows = usable(vectors, column).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    spark = rows.sparkSession
    queries = rows.where(is_query).distinct()
    total, asked = rows.count(), queries.count()
    if not asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    shards, blocks = -(-total // shard), -(-asked // block)
    sample = _arrays(rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).toArrow(), "v")
    # dealt evenly whatever ids repeat; written down if it is read once for each block
    dealt = rows.repartition(shards)
    dealt = cut(dealt) if blocks > 1 else dealt
    answers = []
    for n in range(blocks):
        asked_now = _arrays(queries.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(blocks)) == n).toArrow(), "v")
        start = {}
        for d, (ids, points) in asked_now.items():
            floor = np.full(len(ids), -np.inf)
            if d in sample:
                best = Best(ids, points, floor, k)
                for a in range(0, len(ids), 512):
                    best.offer(np.arange(a, min(a + 512, len(ids))), sample[d][1], sample[d][0])
                floor = best.floor
            start[d] = ids, points, floor
        answers.append(_search(dealt, spark.sparkContext.broadcast(start), k, shard, leaf))
        if blocks > 1:
            answers[-1] = cut(_ranked(answers[-1], k))
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return (_ranked(out, k) if blocks == 1 else out).drop("n")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "n").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n")


def _search(dealt: DataFrame, start, k: int, shard: int, leaf: int) -> DataFrame:
    """query_id, n (which of the query's vectors), vec_id, score: the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(*x, k) for d, x in start.value.items()}
        held: dict[int, list] = {d: [] for d in best}

        def flush(d: int) -> None:
            ids, points = (np.concatenate(x) for x in zip(*held[d]))
            for a in range(0, len(ids), shard):
                best[d].search(grow(points[a : a + shard], ids[a : a + shard], leaf))
            held[d].clear()

        for batch in batches:
            for d, part in _arrays(batch, "v").items():
                if d in held and len(part[0]):
                    held[d].append(part)
                    if sum(len(i) for i, _ in held[d]) >= shard:
                        flush(d)
        for d in held:
            if held[d]:
                flush(d)
            q, n, v, s = [], [], [], []
            seen: dict[int, int] = {}
            for i, (query, heap) in enumerate(zip(best[d].ids.tolist(), best[d].held)):
                nth = d << 20 | seen.setdefault(query, 0)
                seen[query] += 1
                for score, vec in heap:
                    q.append(query), n.append(nth), v.append(-vec), s.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, n, v, s)], names=["query_id", "n", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id bigint, n bigint, vec_id bigint, score bigint")
