import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import graph, neardup


def brute_fp(content):
    w = (content or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    comp = list(range(len(fps)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                comp[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def texts(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out).split()
            for _ in range(r.randint(0, 2)):
                if w:
                    w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
        else:
            out.append(" ".join(word() for _ in range(r.choice([1, 3, 4, 30, 200]))))
    return out


def check(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int, low string").repartition(3)
    got = neardup.cluster(docs, **how).collect()
    assert len(got) == len(rows)
    fps = [brute_fp(t) for _, t, *_ in rows]
    comp = brute_components(fps)
    want = sorted((str(i), f"{fp:016x}", str(min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None))) for (i, *_), fp, c in zip(rows, fps, comp))
    assert sorted((str(g.doc_id), g.fingerprint, str(g.component_id)) for g in got) == want


def test_components_match_brute_force(spark):
    rows = [(i * 7 % 301, t, 0, "x") for i, t in enumerate(texts(300, 1))]
    rows += [(900, None, 0, "x"), (901, "", 0, None), (902, " \n", 1, ""), (None, rows[5][1], 0, "x"), (rows[3][0], rows[3][1], 0, "x"), (903, "Ab\x1cc É d " * 900, 0, "")]
    check(spark, rows)


def test_crowded_buckets_are_linked_exactly(spark):
    check(spark, [(i, t, 0, "x") for i, t in enumerate(texts(150, 2))], bucket=3)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.cluster(empty).count() == 0
    assert neardup.keep_one(empty).count() == 0


def test_thresholds_lose_no_pair():
    r = np.random.default_rng(1)
    both = np.full((64, 64), 250.0) + np.diag(np.full(64, 250.0))
    for n in (10.0, 1e3, 1e6, 1e9):
        chosen = neardup.plan(n, both / 1000 * n)
        assert sorted(b for g, _ in chosen for b in g) == list(range(64))
        assert sum(t for _, t in chosen) == 4 - len(chosen) + 1
        for _ in range(300):
            x = sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False))
            assert any((x & sum(1 << b for b in g)).bit_count() <= t for g, t in chosen)


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(100, 200)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = dict(graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in [*range(101, 200), 500]}


def test_one_row_of_each_component_stays(spark):
    a, b = texts(2, 9)[0] + " one two three four five", "entirely different words here " * 5
    rows = [(5, a, "x"), (5, a, "y"), (3, a, "z"), (8, b, "x"), (8, b, "x"), (9, "", None), (10, None, None), (None, "alone without an id at all", "q"), (None, "alone without an id at all", "q")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 8, 9]


def test_spark_hash_agrees(spark):
    s = "the of and é in"
    assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(s.encode(), 42)


@pytest.mark.parametrize("part_edges", [1 << 18, 40])
def test_components_in_one_part_and_in_several(spark, part_edges):
    r = random.Random(17)
    edges = [(r.randrange(-150, 150), r.randrange(-150, 150)) for _ in range(120)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    group = {x: x for e in edges for x in e}
    for _ in range(70):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = graph.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(3), part_edges=part_edges).collect()
    assert {x.node: x.root for x in got} == {k: g for k, g in group.items() if k != g} and len(got) == len({x.node for x in got})
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), part_edges=part_edges).count() == 0
