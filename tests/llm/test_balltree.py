import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.llm import balltree


def brute(rows, k):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in ok if i % 5 == 0}:
        s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -m) for r, (m, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,block,leaf", [(8192, 4096, 64), (40, 9, 5)])
def test_matches_brute_force(spark, shard, block, leaf):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)], "x") for i in range(230)]
    rows += [(i + 300, rows[i % 3][1], None) for i in range(25)]
    rows += [
        (400, None, "x"), (405, [], "x"), (407, [], "x"), (410, [float("nan")] * 8, "x"), (415, [1.0, None] * 4, "x"), (420, [float("inf")] * 8, "x"),
        (None, [1.0] * 8, "x"), (425, [0.5, 1.0], "x"), (30, rows[30][1], "y"), (35, [3.0] * 8, "y"), (500, [1e5, -3e7] * 4, "x")
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank string").repartition(4)
    got = balltree.top_k(df, F.col("vec_id") % 5 == 0, k=4, shard=shard, block=block, leaf=leaf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 4)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert balltree.top_k(df, F.col("vec_id") % 5 == 0).count() == 0
