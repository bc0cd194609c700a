"""Graphs side by side, walked within rows and by joins."""

import random

import pytest

from tideline.operators import graph


def reachable(edges, start):
    out, todo = set(), [start]
    while todo:
        at = todo.pop()
        new = {b for a, b in edges if a == at} - out
        out |= new
        todo += new
    return out


@pytest.mark.parametrize("max_edges", [20_000, 12, 0])
def test_closure_within_rows_and_by_joins(spark, max_edges):
    r = random.Random(5)
    graphs = {k: [(f"n{r.randrange(8)}", f"n{r.randrange(8)}") for _ in range(size)] for k, size in {"few": 5, "more": 14, "one": 1}.items()}
    edges = spark.createDataFrame([(k, *e) for k, es in graphs.items() for e in es + es[:1]], "key string, cause string, effect string")
    starts = spark.createDataFrame([(k, f"n{i}") for k in [*graphs, "absent"] for i in range(8)] + [("few", "n0")], "key string, start string")
    got = [tuple(x) for x in graph.closure(starts, edges, max_edges=max_edges).select("key", "start", "node").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(k, f"n{i}", n) for k, es in graphs.items() for i in range(8) for n in reachable(es, f"n{i}")}


def test_empty_graphs(spark):
    c = spark.createDataFrame([], "key string, name string, observed boolean, varying boolean, is_outcome boolean")
    e = spark.createDataFrame([], "key string, cause string, effect string, lagged boolean")
    for f in (graph.treatments, graph.cycles, graph.bidirected, graph.projected, graph.blocking_confounders, graph.instruments, graph.components):
        assert f(c, e).count() == 0


def test_graphs_of_one_table_do_not_mix(spark):
    """X and Y share a hidden cause in the first graph alone, and Z is an instrument there; the second has the same names."""
    names = [("X", True), ("Y", True), ("Z", True), ("U", False)]
    c = spark.createDataFrame([(k, n, seen, True, n == "Y") for k in ("bow", "open") for n, seen in names], "key string, name string, observed boolean, varying boolean, is_outcome boolean")
    arrows = [("bow", "Z", "X"), ("bow", "X", "Y"), ("bow", "U", "X"), ("bow", "U", "Y"), ("open", "Z", "X"), ("open", "X", "Y"), ("open", "Z", "Y")]
    e = spark.createDataFrame([(*a, False) for a in arrows], "key string, cause string, effect string, lagged boolean")
    rows = lambda df: {tuple(x) for x in df.collect()}
    assert rows(graph.treatments(c, e)) == {("bow", "X"), ("bow", "Z"), ("bow", "U"), ("open", "X"), ("open", "Z")}
    assert rows(graph.blocking_confounders(c, e)) == {("bow", "X", "U")}
    assert ("bow", "X", "Z") in rows(graph.instruments(c, e)) and not [r for r in rows(graph.instruments(c, e)) if r[0] == "open" and r[1] == "X"]
    assert {r for r in rows(graph.bidirected(c, e)) if r[1].endswith("_t") and r[2].endswith("_t")} == {("bow", "X_t", "Y_t")}
    assert rows(graph.components(c, e)) >= {("bow", "X", "U"), ("open", "X", "X"), ("open", "U", "U")}


def test_blocking_confounders_within_rows_and_by_joins(spark):
    """Random graphs with cycles, unknown constructs, several outcomes and flags that are null."""
    r, nodes, edges = random.Random(8), [], []
    for k in range(400):
        names = [f"n{i}" for i in range(r.randint(1, 7))]
        nodes += [(k, n, r.choice([True, False, False, False, None]), i == 0 or r.random() < 0.1) for i, n in enumerate(names)]
        edges += [(k, r.choice([*names, "other"]), r.choice([*names, "other"]), False) for _ in range(r.randint(0, 14))]
    nodes = spark.createDataFrame(nodes, "key long, name string, observed boolean, is_outcome boolean")
    edges = spark.createDataFrame(edges, "key long, cause string, effect string, lagged boolean")
    want = {tuple(x) for x in graph._blocking_by_joins(nodes, edges).collect()}
    for most in (graph.MAX_EDGES, 8):
        got = [tuple(x) for x in graph.blocking_confounders(nodes, edges, most).select("key", "treatment", "confounder").collect()]
        assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want
