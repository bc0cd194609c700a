"""Which effects of a causal graph can be told from data: many graphs side by side, each under its key.

constructs: key, name, observed, varying, is_outcome; edges: key, cause, effect, lagged. The question is the effect of a
treatment now on the outcome now, in the graph unrolled over two time steps. A graph is written by a person and fits a
row; graphs are dealt out by key. Sets of a graph's nodes are the bits of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.graph import BEFORE, NOW, bits, closed

VERDICT = "key string, treatment string, identifiable boolean, method string, instruments array<string>, blockers array<string>, marginalized array<string>, note string"
DO, IV = "do_calculus", "instrumental_variable"


def reach(starts: Iterable[str], next_of: dict[str, set[str]]) -> set[str]:
    """Everything that starts lead to, themselves included."""
    found, todo = set(), list(starts)
    while todo:
        if (x := todo.pop()) not in found:
            found.add(x)
            todo += next_of.get(x, ())
    return found


def turned(pairs: Iterable[tuple[str, str]], back: bool = False) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for a, b in pairs:
        a, b = (b, a) if back else (a, b)
        out.setdefault(a, set()).add(b)
    return out


def two_steps(varying: set[str], observed: set[str], edges: list[tuple[str, str, bool]], names: set[str]) -> tuple[set[tuple[str, str]], set[str], dict[str, str]]:
    """Edges of the unrolled graph, its observed nodes, and each node's construct; as `graph.unroll`."""
    node = {n + s: n for n in names for s in ((NOW, BEFORE) if n in varying else ("",))}
    out = {(n + BEFORE, n + NOW) for n in varying & observed}
    for a, b, lagged in edges:
        if a not in names or b not in names:
            continue
        if a in varying and b in varying:
            out |= {(a + BEFORE, b + NOW)} if lagged else {(a + NOW, b + NOW), (a + BEFORE, b + BEFORE)}
        elif b in varying:
            out |= {(a, b + NOW), (a, b + BEFORE)}
        elif a not in varying:
            out.add((a, b))
    return out, {k for k, n in node.items() if n in observed}, node


def project(edges: set[tuple[str, str]], seen: set[str]) -> tuple[set[tuple[str, str]], set[tuple[str, str]]]:
    """The latent projection on the seen nodes. Directed: a path whose inner nodes are all hidden; bidirected: a hidden
    node with such paths to both (each pair once, the smaller first)."""
    hidden_next = turned((a, b) for a, b in edges if a not in seen)
    direct = {(a, c) for a, b in edges if a in seen for c in reach([b], hidden_next) & seen}
    both = set()
    for h in {a for a, _ in edges} - seen:
        ends = sorted(reach([h], hidden_next) & seen)
        both |= {(x, y) for i, x in enumerate(ends) for y in ends[i + 1 :]}
    return direct, both


def districts(nodes: set[str], both: set[tuple[str, str]]) -> list[set[str]]:
    """Parts of the nodes that bidirected edges among them hold together."""
    own = [(a, b) for a, b in both if a in nodes and b in nodes]
    joined, out, left = turned(own + [(b, a) for a, b in own]), [], set(nodes)
    while left:
        out.append(reach([min(left)], joined))
        left -= out[-1]
    return out


def identified(treatment: str, outcome: str, direct: set[tuple[str, str]], both: set[tuple[str, str]], nodes: set[str]) -> bool:
    """Whether do-calculus gives the effect of one node on another. The effect is a product over the districts of what leads
    to the outcome without the treatment; each must be had from the district of the whole graph that it lies in."""

    def before(targets: Iterable[str], among: set[str]) -> set[str]:
        return reach(targets, turned(((a, b) for a, b in direct if a in among and b in among), back=True))

    def from_district(part: set[str], whole: set[str]) -> bool:
        while True:
            grown = before(part, whole)
            if grown == part:
                return True
            if grown == whole:
                return False
            whole = next(d for d in districts(grown, both) if part <= d)

    leading = before([outcome], nodes)
    if treatment not in leading:
        return True
    both = {(a, b) for a, b in both if a in leading and b in leading}
    parts = districts(before([outcome], leading - {treatment}), both)
    wholes = districts(leading, both)
    return all(from_district(part, next(w for w in wholes if part <= w)) for part in parts)


class Bits:
    """One graph's constructs, and the latent projection of its unrolled form: construct i has the nodes 2 i now and 2 i + 1
    before, an invariant one the first alone. Names that only edges have come last and take part in paths between
    constructs alone."""

    def __init__(self, names: list[str], observed: list[bool], varying: list[bool], arrows: list[tuple[str, str, bool]]):
        self.place: dict[str, int] = {}
        for n in names:
            self.place.setdefault(n, len(self.place))
        self.known = len(self.place)
        for a, b, _ in arrows:
            self.place.setdefault(a, len(self.place))
            self.place.setdefault(b, len(self.place))
        self.names = list(self.place)
        self.observed = self.varying = 0
        for n, seen, moves in zip(names, observed, varying):
            self.observed |= seen << self.place[n]
            self.varying |= moves << self.place[n]
        self.next, self.before = [0] * len(self.names), [0] * len(self.names)
        self.steps = [0] * (2 * self.known)
        for a, b, lagged in arrows:
            i, j = self.place[a], self.place[b]
            self.next[i] |= 1 << j
            self.before[j] |= 1 << i
            if i < self.known and j < self.known:
                self.unrolled(i, j, lagged)
        both = self.varying & self.observed
        for i in bits(both):
            self.steps[2 * i + 1] |= 1 << 2 * i
        self.seen = self.all = 0
        for i in range(self.known):
            own = (3 if self.varying >> i & 1 else 1) << 2 * i
            self.all |= own
            self.seen |= own if self.observed >> i & 1 else 0

    def unrolled(self, i: int, j: int, lagged: bool) -> None:
        here, there = self.varying >> i & 1, self.varying >> j & 1
        if here and there and lagged:
            self.steps[2 * i + 1] |= 1 << 2 * j
        elif here and there:
            self.steps[2 * i] |= 1 << 2 * j
            self.steps[2 * i + 1] |= 2 << 2 * j
        elif there:
            self.steps[2 * i] |= 3 << 2 * j
        elif not here:
            self.steps[2 * i] |= 1 << 2 * j

    def cyclic(self) -> bool:
        """Whether a node of the unrolled graph leads to itself."""
        left = self.all
        while left:
            last = [n for n in bits(left) if not self.steps[n] & left]
            if not last:
                return True
            for n in last:
                left &= ~(1 << n)
        return False

    def project(self) -> None:
        """As `project`: causes of each seen node, and those that share a hidden cause with it."""
        through = [0 if self.seen >> n & 1 else x for n, x in enumerate(self.steps)]
        self.causes, self.joined = [0] * len(self.steps), [0] * len(self.steps)
        for n in bits(self.all):
            if not self.steps[n]:
                continue
            ends = closed(self.steps[n], through) & self.seen
            for e in bits(ends):
                if self.seen >> n & 1:
                    self.causes[e] |= 1 << n
                else:
                    self.joined[e] |= ends & ~(1 << e)

    def district(self, start: int, among: int) -> int:
        return closed(start, self.joined, among)

    def identified(self, treatment: int, outcome: int) -> bool:
        """As the function of that name."""
        leading = closed(1 << outcome, self.causes, self.seen)
        if not leading >> treatment & 1:
            return True
        left = closed(1 << outcome, self.causes, leading & ~(1 << treatment))
        among = left
        while left:
            part = self.district(left & -left, among)
            left &= ~part
            whole = self.district(part, leading)
            while (grown := closed(part, self.causes, whole)) != part:
                if grown == whole:
                    return False
                whole = self.district(part, grown)
        return True

    def named(self, x: int) -> list[str]:
        return sorted(self.names[i] for i in bits(x))


def verdicts(key, names: list[str], observed: list[bool], varying: list[bool], is_outcome: list[bool], arrows: list[tuple[str, str, bool]]) -> list[tuple]:
    """VERDICT rows of one graph."""
    outcomes = [n for n, x in zip(names, is_outcome) if x]
    if len(outcomes) != 1:
        return [(key, None, False, None, [], [], [], f"{len(outcomes)} outcomes")]
    g = Bits(names, observed, varying, arrows)
    outcome = g.place[outcomes[0]]
    end = 1 << outcome
    treatments = [(n, g.place[n]) for n in g.named(closed(end, g.before) & ~end & g.observed)]
    if not g.observed & end:
        return [(key, t, False, None, [], outcomes, [], "outcome is unobserved") for t, _ in treatments]
    if g.cyclic():
        return [(key, t, False, None, [], [], [], "contemporaneous cycle") for t, _ in treatments]
    g.project()
    confounders = sorted({g.names[n // 2] for n in bits(g.all & ~g.seen) if (below := g.steps[n] & g.seen) & (below - 1)})
    hidden = [u for u in bits(((1 << g.known) - 1) & ~g.observed & ~end) if g.next[u] & g.observed]
    out = []
    for t, i in treatments:
        if g.identified(2 * i, 2 * outcome):
            out.append((key, t, True, DO, [], [], confounders, None))
            continue
        own = 1 << i
        causes = closed(end, [0 if k == i else x for k, x in enumerate(g.before)]) & ~end
        cut = [x & ~own for x in g.next]
        after = 0
        for c in bits(causes):
            after |= cut[c]
        instruments = g.named(g.before[i] & ~(causes | closed(after, cut)) & g.observed)
        if instruments:
            out.append((key, t, True, IV, instruments, [], confounders, None))
            continue
        past = [0 if k == i else x for k, x in enumerate(cut)]
        blockers = 0
        for u in hidden:
            if closed(g.next[u], g.next) & own and closed(past[u], past) & end:
                blockers |= 1 << u
        out.append((key, t, False, None, [], g.named(blockers), [], None))
    return out


def judge(key, constructs: pd.DataFrame, edges: pd.DataFrame) -> list[tuple]:
    flags = [constructs[c].astype(bool).tolist() for c in ("observed", "varying", "is_outcome")]
    return verdicts(key, constructs.name.tolist(), *flags, list(zip(edges.cause, edges.effect, edges.lagged)))


def effects(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """VERDICT: a row for each observed construct that leads to its graph's outcome. Do-calculus is tried first, then
    instruments (sound if effects are linear), else the hidden constructs that block are named. A hidden outcome or a cycle
    within a time step leaves nothing identifiable; edges between unknown constructs count for paths only. A graph with
    none or several outcomes gives one row, without treatment, that says so; one without edges gives no rows. Null flags
    count as false."""
    flags, ends = ("observed", "varying", "is_outcome"), ("cause", "effect", "lagged")
    none = lambda columns, kinds: [F.lit(None).cast(k).alias(c) for c, k in zip(columns, kinds)]
    nodes = constructs.where("name is not null").select(
        F.col("key").cast("string").alias("key"), "name", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags], *none(ends, ("string", "string", "boolean"))
    )
    arrows = edges.where("cause is not null and effect is not null").select(
        F.col("key").cast("string").alias("key"), *none(("name", *flags), ("string", "boolean", "boolean", "boolean")), "cause", "effect", F.coalesce("lagged", F.lit(False)).alias("lagged")
    )
    # the number of parts is named, since few bytes can be much work
    parts = int(constructs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    graphs = nodes.unionByName(arrows).repartition(parts, "key").groupBy("key").agg(*[F.collect_list(c).alias(c) for c in ("name", *flags, *ends)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.split() for f in VERDICT.split(", ")]
        kinds = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                rows = []
                for key, names, observed, varying, is_outcome, cause, effect, lagged in zip(*(c.to_pylist() for c in whole.slice(at, 1000).columns)):
                    if names:
                        rows += verdicts(key, names, observed, varying, is_outcome, list(zip(cause, effect, lagged)))
                columns = list(zip(*rows)) if rows else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])

    return graphs.mapInArrow(run, VERDICT)


def unobserved_roles(constructs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(key, construct, can_marginalize, reason, blocks): hidden constructs that block no observed treatment can be left out
    of a model; blocks: the treatments that the others stand in the way of."""
    hidden = constructs.where("not observed").select(F.col("key").cast("string").alias("key"), F.col("name").alias("construct"))
    blocking = verdicts.where("not identifiable").select("key", "treatment", F.explode("blockers").alias("construct")).groupBy("key", "construct").agg(F.sort_array(F.collect_set("treatment")).alias("blocks"))
    handled = verdicts.select("key", F.explode("marginalized").alias("construct")).distinct().withColumn("handled", F.lit(True))
    out = hidden.join(blocking, ["key", "construct"], "left").join(handled, ["key", "construct"], "left")
    reason = F.when(F.col("blocks").isNull(), F.when(F.col("handled"), "handled by the identification").otherwise("does not confound"))
    return out.select("key", "construct", F.col("blocks").isNull().alias("can_marginalize"), reason.alias("reason"), F.coalesce("blocks", F.array().cast("array<string>")).alias("blocks"))


def to_fix(constructs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(key, construct): constructs that block some treatment, each once."""
    own = constructs.select(F.col("key").cast("string").alias("key"), F.col("name").alias("construct"))
    return verdicts.where("not identifiable").select("key", F.explode("blockers").alias("construct")).distinct().join(own, ["key", "construct"], "left_semi")


def summary(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, constructs, observed, varying, edges, lagged, outcome) of every graph."""
    own = constructs.groupBy(F.col("key").cast("string").alias("key")).agg(
        F.count("*").alias("constructs"), F.count_if("observed").alias("observed"), F.count_if("varying").alias("varying"), F.max(F.when(F.col("is_outcome"), F.col("name"))).alias("outcome")
    )
    between = edges.groupBy(F.col("key").cast("string").alias("key")).agg(F.count("*").alias("edges"), F.count_if("lagged").alias("lagged"))
    return own.join(between, "key", "left").select("key", "constructs", "observed", "varying", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("edges", "lagged")], "outcome")
