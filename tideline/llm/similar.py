"""Near-duplicates by SimHash fingerprints and exact similarity of word shingles.

Two texts are linked if the sets of their SHINGLE-word shingles have at least SIMILARITY of their union in common. Texts
with equal sets form a class, and classes are compared. First come those whose SimHash fingerprints meet by the generalised
pigeonhole principle (`neardup.links`); what passes the check on the shingles is joined. Pairs that this does not join are
found by bands of ROWS minimum hashes: of BANDS bands a pair at similarity 0.8 shares none with chance (1 - 0.8^5)^30 = 7 in
a million, a closer one with less. They too are checked on the shingles themselves.

A crowded band does not pair its members. Those joined by crowded bands are a crowd, however large: its members are
compared with LEADERS of them, wherever they lie, and those that leaders join are left to themselves; only the others are
compared with the whole crowd, block by block, each block in a task of its own and handing on a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import graph, neardup
from tideline.llm import text as tx
from tideline.llm.spark_io import cut, tidied

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 30, 5
#: Classes of a band that are compared pair by pair; a larger band is crowded.
CROWD = 32
#: Members of a crowd that all are compared with, parts that a crowd is dealt into for that, and shingles of a block.
LEADERS, PARTS, BLOCK = 8, 16, 1 << 21
#: Share of equal minimum hashes below which members of a crowd are not compared: over seven deviations below SIMILARITY.
SKETCH = 0.55

_draw = np.random.default_rng(SEED)
FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
BAND_FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MARKS = "doc_id bigint, text_hash bigint, fp bigint, n int, simhash bigint, bands array<bigint>"


def shingle_set(content: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of all words together if there are fewer words."""
    return np.unique(np.array(neardup.shingle_hashes(content, shingle, SEED), np.uint64))


def class_key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minimum hashes for each set; no set may be empty."""
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    return np.stack([np.minimum.reduceat(flat * f, starts) for f in FACTORS], axis=1)


def band_keys(signature: np.ndarray) -> np.ndarray:
    mixed = ((signature ^ (signature >> np.uint64(29))) * BAND_FACTORS).reshape(len(signature), BANDS, ROWS)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :]


def marks(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """MARKS of every row: fp is the class, n its shingles; a text without words has no bands. simhash: the bits set in over
    half of the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
                n = np.array([len(s) for s in sets], np.int32)
                full = [s for s in sets if len(s)]
                keys = band_keys(signatures(full)).ravel() if full else np.zeros(0, np.uint64)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                fp = np.array([class_key(s) for s in sets], np.uint64)
                simhash = neardup.majority(np.concatenate(sets), n.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("text_hash"), pa.array(fp.view(np.int64)), pa.array(n),
                        pa.array(simhash.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64))),
                    ],
                    names=["doc_id", "text_hash", "fp", "n", "simhash", "bands"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("text_hash"), "text").mapInArrow(tidied(run), MARKS)


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near(classes: DataFrame, radius: int = neardup.RADIUS) -> DataFrame:
    """(a, b): classes whose fingerprints differ in at most `radius` bits, by partitions with thresholds as in `neardup`. Of
    classes with one fingerprint the first stands for all and is linked to each."""
    own = classes.where("n > 0").select("simhash", "fp")
    firsts = cut(own.groupBy("simhash").agg(F.min("fp").alias("first")))
    marked = firsts.select(F.col("simhash").alias("fp"))
    found = neardup.links(marked, neardup.plan(*neardup.bit_moments(marked), radius), radius)
    ends = [firsts.select(F.col("simhash").alias(x), F.col("first").alias(f"_{x}")) for x in "ab"]
    apart = found.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    equal = own.join(firsts, "simhash").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    both = apart.unionByName(equal)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidates(classes: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """(kind, a, b): kind 0, two classes of one band whose sizes allow the similarity; kind 1, a class of a crowded band
    and the first of that band."""
    met = classes.select("fp", "n", F.explode("bands").alias("key")).repartition("key").sortWithinPartitions("key", "n", "fp")

    def out(a: list[np.ndarray], b: list[np.ndarray], kind: int) -> pa.RecordBatch:
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["kind", "a", "b"])

    def closed(key: np.ndarray, fp: np.ndarray, n: np.ndarray, crowded_first: bool) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        big = sizes > crowd
        big[0] |= crowded_first
        in_big = np.repeat(big, sizes)
        if in_big.any():
            yield out([fp[in_big]], [np.repeat(fp[starts], sizes)[in_big]], 1)
        live, a, b = np.flatnonzero(~in_big), [], []
        for step in range(1, crowd):
            live = live[live + step < len(key)]
            live = live[key[live] == key[live + step]]
            if not len(live):
                break
            fit = live[n[live] >= similarity * n[live + step] - 1e-9]
            a.append(fp[fit])
            b.append(fp[fit + step])
        yield out(a, b, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, crowded = [np.zeros(0, np.int64)] * 3, False  # the band that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, n = (np.concatenate([o, batch.column(c).to_numpy(zero_copy_only=False)]) for o, c in zip(open_, ["key", "fp", "n"]))
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if last:
                yield from closed(key[:last], fp[:last], n[:last], crowded)
                crowded = False
            open_ = [key[last:], fp[last:], n[last:]]
            if len(open_[0]) > crowd:
                yield out([open_[1]], [np.full(len(open_[1]), open_[1][0])], 1)
                open_, crowded = [x[:1] for x in open_], True
        if len(open_[0]):
            yield from closed(*open_, crowded)

    return met.mapInArrow(tidied(run), "kind int, a bigint, b bigint").distinct()


def shared(a: np.ndarray, b: np.ndarray) -> float:
    """What two sorted sets have in common, of their union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def forest(keys: np.ndarray, sets: list[np.ndarray], similarity: float, first: int | None = None) -> list[tuple[int, int]]:
    """Links of at least the similarity that join what the first few sets (all of them by default) have links to: of
    sets that are joined already none is compared."""
    if not sets:
        return []
    signature = np.concatenate([signatures(sets[i : i + 256]) for i in range(0, len(sets), 256)])
    sizes, group, found = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    for x in range(len(sets) if first is None else first):
        fit = (group != group[x]) & (np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x]) - 1e-9)
        some = np.flatnonzero(fit)
        some = some[(signature[some] == signature[x]).mean(axis=1) >= SKETCH] if len(some) else some
        for y in some.tolist():
            if group[y] != group[x] and shared(sets[x], sets[y]) >= similarity:
                found.append((int(keys[x]), int(keys[y])))
                group[group == group[y]] = group[x]
    return found


def crowd_links(members: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect what is similar within each crowd. members: root (of the crowd), fp, own (its shingles)."""
    by_spot = Window.partitionBy("root").orderBy(F.xxhash64("fp", F.lit(1)), "fp")
    leaders = members.select("root", "fp").withColumn("k", F.row_number().over(by_spot)).where(F.col("k") <= LEADERS)
    led = leaders.join(members, ["root", "fp"]).select("root", F.col("fp").alias("leader"), "k", F.col("own").alias("own_b"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    dealt = members.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(2)), F.lit(PARTS)).cast("int"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _sets(batch.column("own")), _sets(batch.column("own_b"))
            near = [len(x) >= similarity * len(y) - 1e-9 and len(y) >= similarity * len(x) - 1e-9 and shared(x, y) >= similarity for x, y in zip(a, b)]
            yield batch.select(["root", "fp", "leader", "k"]).append_column("near", pa.array(near, pa.bool_()))

    met = cut(dealt.join(led, ["root", "part"]).select("root", "fp", "leader", "k", "own", "own_b").mapInArrow(tidied(compared), "root bigint, fp bigint, leader bigint, k int, near boolean"))
    masks = met.groupBy("root", "fp").agg(F.sum(F.when(F.col("near"), F.expr("shiftleft(1, k - 1)")).otherwise(0)).cast("int").alias("mask"))
    kinds = masks.groupBy("root", "mask").agg(F.count("*").alias("n"))

    def largest(kind: pa.Table) -> pa.Table:
        """Of at most 2 ** LEADERS sets of leaders: whether each belongs to those that join most members."""
        mask, n = kind.column("mask").to_pylist(), kind.column("n").to_pylist()
        joined: list[int] = []
        for m in [m for m in mask if m]:
            apart = [j for j in joined if not j & m]
            for j in joined:
                m |= j if j & m else 0
            joined = [*apart, m]
        top = max(joined, key=lambda j: (sum(c for m, c in zip(mask, n) if m & j), j), default=0)
        return pa.table({"root": kind.column("root"), "mask": kind.column("mask"), "top": pa.array([bool(m & top) for m in mask], pa.bool_())})

    tops = kinds.groupBy("root").applyInArrow(largest, "root bigint, mask int, top boolean")
    rest = cut(masks.join(tops, ["root", "mask"]).where("not top").select("root", "fp"))
    total = members.groupBy("root").agg(F.ceil(F.sum(F.size("own")) / F.lit(block)).cast("int").alias("blocks"))
    others = members.join(rest, ["root", "fp"], "left_semi")
    total_rest = others.groupBy("root").agg(F.ceil(F.sum(F.size("own")) / F.lit(block)).cast("int").alias("rest_blocks"))
    blocks = cut(total.join(total_rest, "root"))
    spot = lambda n: F.pmod(F.xxhash64("fp", F.lit(3)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = others.join(blocks, "root").select("root", "fp", "own", spot("rest_blocks").alias("i"), each("blocks").alias("j"), F.lit(0).alias("kind"))
    asked = members.join(blocks, "root").select("root", "fp", "own", each("rest_blocks").alias("i"), spot("blocks").alias("j"), F.lit(1).alias("kind"))

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by([("kind", "ascending"), ("fp", "ascending")])
        keys, kind = group.column("fp").to_numpy(), group.column("kind").to_numpy()
        own, asking = [s for c in group.column("own").chunks for s in _sets(c)], int((kind == 0).sum())
        use = np.flatnonzero((kind == 0) | ~np.isin(keys, keys[:asking]))
        found = forest(keys[use], [own[i] for i in use], similarity, asking)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    apart = asks.unionByName(asked).groupBy("root", "i", "j").applyInArrow(joined, "a bigint, b bigint")
    return met.where("near and fp <> leader").select(F.col("fp").alias("a"), F.col("leader").alias("b")).unionByName(apart)


def rooted(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges, roots included."""
    roots = graph.components(edges)
    return cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct())


def across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs that do not lie within one of the groups (node, root)."""
    apart = groups.select(F.col("node").alias("a"), F.col("root").alias("_r")), groups.select(F.col("node").alias("b"), F.col("root").alias("_s"))
    return pairs.join(apart[0], "a", "left").join(apart[1], "b", "left").where("_r is null or _s is null or _r <> _s").select("a", "b")


def links(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """(a, b): checked links that connect whatever is similar."""
    close = cut(near(classes))
    found = cut(candidates(classes, similarity, crowd))
    pairs = found.where("kind = 0").select("a", "b")
    crowds = rooted(found.where("kind = 1").select("a", "b"))
    ends = close.unionByName(pairs).select(F.explode(F.array("a", "b")).alias("fp")).union(crowds.select("node")).distinct()
    wanted = classes.join(ends, "fp", "left_semi").select("fp", "text_hash")
    texts = docs.select(text_hash().alias("text_hash"), "text").join(wanted, "text_hash").dropDuplicates(["fp"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                own = [shingle_set(t, shingle).view(np.int64) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(own, pa.list_(pa.int64()))], names=["fp", "own"])

    sets = cut(texts.select("fp", "text").mapInArrow(tidied(hashed), "fp bigint, own array<bigint>"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_sets(batch.column(c)) for c in ("own_a", "own_b"))
            yield batch.select(["a", "b"]).filter(pa.array([shared(x, y) >= similarity for x, y in zip(a, b)], pa.bool_()))

    left, right = sets.select(F.col("fp").alias("a"), F.col("own").alias("own_a")), sets.select(F.col("fp").alias("b"), F.col("own").alias("own_b"))
    alike = lambda some: some.join(left, "a").join(right, "b").select("a", "b", "own_a", "own_b").mapInArrow(tidied(checked), "a bigint, b bigint")
    first = cut(alike(close))
    direct = first.unionByName(alike(across(across(pairs, rooted(first)), crowds)))
    if crowds.isEmpty():
        return direct
    return direct.unionByName(crowd_links(cut(sets.join(crowds, sets.fp == crowds.node).select("root", "fp", "own")), similarity))


def _sets(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(column.offsets)
    at = at - at[0]
    return [flat[i:j] for i, j in zip(at[:-1], at[1:])]


def cluster(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs, as of neardup.cluster: doc_id, fingerprint (of the class) and component_id, the smallest
    doc_id reachable over links of at least the similarity. Texts without words form one class."""
    own = cut(marks(docs, shingle))
    lows = own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("text_hash").alias("text_hash"))
    details = own.select("fp", F.col("text_hash").alias("_t"), "n", "simhash", "bands")
    classes = cut(lows.join(details, (lows.fp == details.fp) & (lows.text_hash == details._t)).select(lows.fp, "low", "text_hash", "n", "simhash", "bands").dropDuplicates(["fp"]))
    roots = graph.components(links(docs, classes, similarity, shingle, crowd))
    return neardup.labelled(own, classes, roots)
