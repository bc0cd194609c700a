"""Causal graphs as two tables: constructs (key, name, observed, varying, is_outcome) and edges (key, cause, effect, lagged).

Many graphs lie side by side under `key`, which is null for none; every result carries it. A graph written by a person
fits a row and is walked by array functions, or as bits of whole numbers; one of more edges than that is walked by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.lineage import cut

#: Edges of a graph that is walked within a row.
MAX_EDGES = 20_000
NOW, BEFORE = "_t", "_{t-1}"


def bits(x: int) -> list[int]:
    out = []
    while x:
        out.append((x & -x).bit_length() - 1)
        x &= x - 1
    return out


def closed(todo: int, next_of: list[int], among: int = -1) -> int:
    """Everything that a set of nodes, as bits, leads to, itself included; among: the nodes that a step may start from and end at."""
    found = 0
    while todo:
        found |= todo
        left, new = todo & among, 0
        while left:
            new |= next_of[(left & -left).bit_length() - 1]
            left &= left - 1
        todo = new & among & ~found
    return found


def closure(starts: DataFrame, edges: DataFrame, key: str = "key", max_edges: int = MAX_EDGES) -> DataFrame:
    """(key, start, node): every node that start reaches over one edge or more in the graph of its key, whether or not
    the graph has cycles. starts: (key, start); edges: (key, cause, effect); repeats count once. A graph of over `max_edges`
    edges takes no row of its own: its nodes are found by a join for each step."""
    large = edges.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max_edges).select(key)
    if large.isEmpty():
        return _walked(starts, edges, key)
    small = _walked(starts.join(large, key, "left_anti"), edges.join(large, key, "left_anti"), key)
    return small.unionByName(_joined(starts.join(large, key, "left_semi"), edges.join(large, key, "left_semi"), key))


def _walked(starts: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    graphs = edges.groupBy(key).agg(F.array_distinct(F.collect_list(F.struct("cause", "effect"))).alias("_e"))
    step = lambda seen: F.transform(F.filter("_e", lambda e: F.array_contains(seen, e["cause"])), lambda e: e["effect"])
    first = F.array_distinct(F.transform(F.filter("_e", lambda e: e["cause"] == F.col("start")), lambda e: e["effect"]))
    nodes = F.size(F.array_distinct(F.transform("_e", lambda e: e["effect"])))
    reached = F.aggregate(F.sequence(F.lit(1), F.greatest(nodes, F.lit(1))), first, lambda seen, _: F.array_union(seen, step(seen)))
    return starts.distinct().join(graphs, key).select(key, "start", F.explode(reached).alias("node"))


def _joined(starts: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Semi-naive: each step follows the edges of the nodes that the step before was the first to reach."""
    arrows = cut(edges.select(key, F.col("cause").alias("node"), F.col("effect").alias("_to")).distinct())
    new = cut(starts.select(key, "start").distinct().join(arrows.withColumnRenamed("node", "start"), [key, "start"]).select(key, "start", F.col("_to").alias("node")).distinct())
    reached = new
    while not new.isEmpty():
        further = new.join(arrows, [key, "node"]).select(key, "start", F.col("_to").alias("node")).distinct()
        new = cut(further.join(reached, [key, "start", "node"], "left_anti"))
        reached = cut(reached.unionByName(new))
    return reached


def descendants(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, ancestor, node) over all constructs."""
    return closure(constructs.select("key", F.col("name").alias("start")), edges).select("key", F.col("start").alias("ancestor"), "node")


def treatments(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, treatment): everything with a directed path to its graph's outcome."""
    outcome = constructs.where("is_outcome").select("key", F.col("name").alias("node"))
    found = descendants(constructs, edges).join(outcome, ["key", "node"], "left_semi")
    found = found.join(outcome.select("key", F.col("node").alias("ancestor")), ["key", "ancestor"], "left_anti")
    return found.select("key", F.col("ancestor").alias("treatment")).distinct()


def cycles(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, node): constructs that lie on a cycle of contemporaneous edges."""
    return descendants(constructs, edges.where("not lagged")).where("ancestor = node").select("key", "node")


def unroll(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, cause, effect) over two time steps: an observed varying construct carries over to itself; contemporaneous edges
    hold in both steps, lagged ones lead from the first into the second; an invariant cause acts on both steps. Edges
    from a varying to an invariant construct are left out."""
    kind = constructs.select("key", "name", "varying")
    e = edges.join(kind.select("key", F.col("name").alias("cause"), F.col("varying").alias("cv")), ["key", "cause"]).join(
        kind.select("key", F.col("name").alias("effect"), F.col("varying").alias("ev")), ["key", "effect"]
    )
    now = lambda c: F.concat(c, F.lit(NOW))
    before = lambda c: F.concat(c, F.lit(BEFORE))
    arrow = lambda a, b: F.struct(a.alias("cause"), b.alias("effect"))
    c, f = F.col("cause"), F.col("effect")
    made = (
        F.when(~F.col("cv") & ~F.col("ev"), F.array(arrow(c, f)))
        .when(~F.col("cv"), F.array(arrow(c, now(f)), arrow(c, before(f))))
        .when(~F.col("ev"), F.array().cast("array<struct<cause:string,effect:string>>"))
        .when(F.col("lagged"), F.array(arrow(before(c), now(f))))
        .otherwise(F.array(arrow(now(c), now(f)), arrow(before(c), before(f))))
    )
    own = constructs.where("varying and observed").select("key", before(F.col("name")).alias("cause"), now(F.col("name")).alias("effect"))
    return e.select("key", F.explode(made).alias("x")).select("key", "x.*").unionByName(own).distinct()


def unrolled_nodes(constructs: DataFrame) -> DataFrame:
    """(key, node, construct, observed) of both steps."""
    steps = F.when(F.col("varying"), F.array(F.concat("name", F.lit(NOW)), F.concat("name", F.lit(BEFORE)))).otherwise(F.array("name"))
    return constructs.select("key", F.explode(steps).alias("node"), F.col("name").alias("construct"), "observed")


def hidden_confounders(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, node, construct, children): hidden nodes of the unrolled graph with at least two observed children."""
    nodes = unrolled_nodes(constructs)
    e = unroll(constructs, edges)
    hidden = nodes.where("not observed").select("key", F.col("node").alias("cause"), "construct")
    seen = nodes.where("observed").select("key", F.col("node").alias("effect"))
    return e.join(hidden, ["key", "cause"]).join(seen, ["key", "effect"], "left_semi").groupBy("key", "cause", "construct").agg(F.countDistinct("effect").alias("children")).where("children >= 2").withColumnRenamed("cause", "node")


def bidirected(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, a, b): pairs of observed nodes with a common hidden cause in the unrolled graph, reached through hidden nodes
    alone: the bidirected edges of the latent projection."""
    nodes = unrolled_nodes(constructs)
    e = unroll(constructs, edges)
    hidden = nodes.where("not observed").select("key", F.col("node").alias("cause"))
    seen = nodes.where("observed").select("key", "node")
    from_hidden = e.join(hidden, ["key", "cause"], "left_semi")
    reached = closure(hidden.select("key", F.col("cause").alias("start")), from_hidden).join(seen, ["key", "node"], "left_semi").select("key", "start", "node")
    other = reached.select("key", "start", F.col("node").alias("b"))
    return reached.withColumnRenamed("node", "a").join(other, ["key", "start"]).where("a < b").select("key", "a", "b").distinct()


def projected(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, cause, effect): observed nodes of the unrolled graph joined by a path whose inner nodes are all hidden: the directed
    edges of the latent projection."""
    nodes, e = unrolled_nodes(constructs), unroll(constructs, edges)
    seen, hidden = nodes.where("observed").select("key", "node"), nodes.where("not observed").select("key", F.col("node").alias("cause"))
    first = e.join(seen.select("key", F.col("node").alias("cause")), ["key", "cause"], "left_semi")
    through = closure(hidden.select("key", F.col("cause").alias("start")), e.join(hidden, ["key", "cause"], "left_semi"))
    far = first.join(through.select("key", F.col("start").alias("effect"), "node"), ["key", "effect"]).select("key", "cause", F.col("node").alias("effect"))
    return first.unionByName(far).join(seen.select("key", F.col("node").alias("effect")), ["key", "effect"], "left_semi").select("key", "cause", "effect").distinct()


def _per_treatment(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge once for each treatment of its graph; (key, treatment) is the new graph's key, named `pair`."""
    own = edges.join(treatments(constructs, edges), "key")
    return own.select(F.struct("key", "treatment").alias("pair"), "key", "treatment", "cause", "effect")


def blocking_confounders(constructs: DataFrame, edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(key, treatment, confounder): hidden constructs with an observed child that lead to the treatment and, past it, to
    the outcome. A graph is walked within its row, or by joins if it has more than `max_edges` edges."""
    large = edges.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > max_edges).select("key")
    if large.isEmpty():
        return _blocking_in_rows(constructs, edges)
    small = _blocking_in_rows(constructs.join(large, "key", "left_anti"), edges.join(large, "key", "left_anti"))
    return small.unionByName(_blocking_by_joins(constructs.join(large, "key", "left_semi"), edges.join(large, "key", "left_semi")))


def _blocking_in_rows(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    nodes = constructs.where("key is not null and name is not null").select(
        "key", "name", flag("observed").alias("observed"), F.coalesce(~F.col("observed") & ~F.col("is_outcome"), F.lit(False)).alias("hidden"), flag("is_outcome").alias("is_outcome")
    )
    arrows = edges.where("key is not null and cause is not null and effect is not null").select("key", "cause", "effect")
    both = nodes.unionByName(arrows, allowMissingColumns=True)
    # the number of parts is named, since few bytes can be much work
    parts = int(constructs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ("name", "observed", "hidden", "is_outcome", "cause", "effect")
    graphs = both.repartition(parts, "key").groupBy("key").agg(*[F.collect_list(c).alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, treatments, confounders = [], [], []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in columns))):
                for t, c in blocking(*row):
                    keys.append(i)
                    treatments.append(t)
                    confounders.append(c)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), pa.array(treatments, pa.string()), pa.array(confounders, pa.string())], names=["key", "treatment", "confounder"])

    return graphs.mapInArrow(run, f"key {dict(constructs.dtypes)['key']}, treatment string, confounder string")


def blocking(names: list[str], observed: list[bool], hidden: list[bool], is_outcome: list[bool], causes: list[str], effects: list[str]) -> list[tuple[str, str]]:
    """(treatment, confounder) pairs of one graph."""
    place = {n: i for i, n in enumerate(dict.fromkeys([*names, *causes, *effects]))}
    label, after, before = list(place), [0] * len(place), [0] * len(place)
    for a, b in zip(causes, effects):
        after[place[a]] |= 1 << place[b]
        before[place[b]] |= 1 << place[a]
    seen = unseen = ends = known = 0
    for n, s, h, e in zip(names, observed, hidden, is_outcome):
        own = 1 << place[n]
        known, seen, unseen, ends = known | own, seen | (own if s else 0), unseen | (own if h else 0), ends | (own if e else 0)
    starts = [u for u in bits(unseen) if after[u] & seen]
    led = {u: closed(after[u], after) for u in starts}
    out = []
    for t in bits(closed(ends, before) & known & ~ends):
        own = 1 << t
        # what leads to an outcome, over one edge or more, without passing the treatment
        ways = closed(ends & ~own, [x & ~own for x in before], ~own)
        for u in starts:
            if u != t and led[u] & own and after[u] & ways:
                out.append((label[t], label[u]))
    return out


def _blocking_by_joins(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    outcome = constructs.where("is_outcome").select("key", F.col("name").alias("node"))
    seen = constructs.where("observed").select("key", F.col("name").alias("effect"))
    parents = edges.join(seen, ["key", "effect"], "left_semi").select("key", F.col("cause").alias("name"))
    hidden = constructs.where("not observed and not is_outcome").select("key", "name").join(parents, ["key", "name"], "left_semi")
    to_treatment = descendants(constructs, edges).select("key", F.col("ancestor").alias("confounder"), F.col("node").alias("treatment"))
    past = _per_treatment(constructs, edges).where("cause <> treatment and effect <> treatment")
    starts = past.select("pair", "key", F.col("cause").alias("start")).join(hidden.withColumnRenamed("name", "start"), ["key", "start"], "left_semi")
    reach = closure(starts.select("pair", "start"), past.select("pair", "cause", "effect"), "pair").select("pair.key", "pair.treatment", "start", "node")
    reaching = reach.join(outcome, ["key", "node"], "left_semi").select("key", "treatment", F.col("start").alias("confounder"))
    return reaching.join(to_treatment, ["key", "treatment", "confounder"], "left_semi").where("treatment <> confounder").distinct()


def instruments(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, treatment, instrument): observed parents of the treatment that, once its incoming edges are cut, neither lead
    to the outcome nor come after anything that does."""
    outcome = constructs.where("is_outcome").select("key", F.col("name").alias("node"))
    own = _per_treatment(constructs, edges)
    kept = own.where("effect <> treatment").select("pair", "cause", "effect")
    reach = closure(kept.select("pair", F.col("cause").alias("start")), kept, "pair").select("pair.key", "pair.treatment", "start", "node")
    causes = reach.join(outcome, ["key", "node"], "left_semi").select("key", "treatment", F.col("start").alias("instrument"))
    after = reach.join(causes.withColumnRenamed("instrument", "start"), ["key", "treatment", "start"], "left_semi").select("key", "treatment", F.col("node").alias("instrument"))
    seen = constructs.where("observed").select("key", F.col("name").alias("instrument"))
    parents = own.where("effect = treatment").select("key", "treatment", F.col("cause").alias("instrument")).distinct()
    return parents.join(causes.unionByName(after), ["key", "treatment", "instrument"], "left_anti").join(seen, ["key", "instrument"], "left_semi").select("key", "treatment", "instrument")


def edge_problems(constructs: DataFrame, edges: DataFrame, hours: dict[str, int]) -> DataFrame:
    """(key, cause, effect, problem): unknown ends, exogenous effects, contemporaneous edges between different grains.
    constructs also has role and granularity."""
    own = constructs.select("key", "name", "role", "granularity", "varying")
    end = lambda side, p: own.select("key", F.col("name").alias(side), F.lit(True).alias(f"{p}_known"), *[F.col(c).alias(f"{p}_{c}") for c in ("role", "granularity", "varying")])
    wide = edges.join(end("cause", "c"), ["key", "cause"], "left").join(end("effect", "e"), ["key", "effect"], "left")
    found = F.array_compact(
        F.array(
            F.when(F.col("c_known").isNull(), F.lit("unknown cause")),
            F.when(F.col("e_known").isNull(), F.lit("unknown effect")),
            F.when(F.col("e_role") == "exogenous", F.lit("exogenous effect")),
            F.when(~F.col("lagged") & F.col("c_varying") & F.col("e_varying") & ~F.col("c_granularity").eqNullSafe(F.col("e_granularity")), F.lit("grains differ")),
        )
    )
    return wide.select("key", "cause", "effect", F.explode(found).alias("problem"))


def lag_hours(cause: Column, effect: Column, lagged: Column, hours: dict[str, int]) -> Column:
    """Hours of lag of an edge: the longer grain if the grains differ, the common one if lagged, else none."""
    table = F.create_map(*[x for k, h in hours.items() for x in (F.lit(k), F.lit(h))])
    long = F.greatest(F.coalesce(table[cause], F.lit(0)), F.coalesce(table[effect], F.lit(0)))
    return F.when(~cause.eqNullSafe(effect) | lagged, long).otherwise(F.lit(0))


def drift_mask(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, effect, cause): free entries of the drift matrix, the diagonal included."""
    return edges.select("key", "effect", "cause").unionByName(constructs.select("key", F.col("name").alias("effect"), F.col("name").alias("cause"))).distinct()


def loading_mask(indicators: DataFrame) -> DataFrame:
    """(key, indicator, construct, free): a construct's first indicator is fixed at one, its others are free."""
    first = F.row_number().over(Window.partitionBy("key", "construct").orderBy("pos")) == 1
    return indicators.select("key", "indicator", "construct", (~first).alias("free"))


def components(constructs: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, name, component): connected components over edges in either direction, named by their first member."""
    own = edges.select("key", "cause", "effect")
    both = own.unionByName(own.select("key", F.col("effect").alias("cause"), F.col("cause").alias("effect")))
    reach = closure(constructs.select("key", F.col("name").alias("start")), both).groupBy("key", F.col("start").alias("name")).agg(F.min("node").alias("low"))
    return constructs.select("key", "name").join(reach, ["key", "name"], "left").select("key", "name", F.least("name", "low").alias("component"))
