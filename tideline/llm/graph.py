"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.spark_io import cut

#: Edges (16 bytes each) to a part of what a round reads, so that the files of a round grow with its edges and not with
#: the parts that the edges came in.
PART_EDGES = 1 << 18


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h % (1 << 31)), F.sum(F.shiftrightunsigned(h, 33))).first())


def components(edges: DataFrame, max_rounds: int = 60, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b: longs, in any order, repeats and loops allowed), where root
    is the smallest node of its component; a node that is itself the root has no row.

    Each round links every node's larger neighbours to its smallest neighbour, then every node's smaller neighbours to
    the smallest of them; the number of rounds grows with the logarithm of the longest path. A round is two
    pre-aggregated minima and two joins, so a hub with any number of neighbours is one row on the joined side. It reads
    its edges in parts of about `part_edges`, and so do its later steps."""
    sized = lambda e, n: e.coalesce(max(1, -(-n // part_edges)))
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        e = sized(e, state[0])
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sized(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), state[0]).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(sized(near.unionByName(low.withColumnRenamed("m", "b")), state[0]).distinct())
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
