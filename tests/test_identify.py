"""Verdicts over graphs whose answers are known (section C of FIXTURES.md)."""

import random
import re
from pathlib import Path

from tideline.operators import identify


def cases():
    for line in Path(__file__).resolve().parent.parent.joinpath("FIXTURES.md").read_text().splitlines():
        cells = [c.strip() for c in line.split("|")]
        if len(cells) == 9 and cells[1].isdigit():
            edges = [(*re.split("[→⇢]", e), "⇢" in e) for e in cells[4].split()]
            yield cells[2], cells[3], edges, set(cells[5].split(",")), set() if cells[6] == "–" else set(cells[6].split(",")), cells[7].split()


def tables(spark, rows):
    nodes, arrows = [], []
    for key, outcome, edges, observed, fixed, _ in rows:
        for n in sorted({x for e in edges for x in e[:2]} | observed):
            nodes.append((key, n, n in observed, n not in fixed, n == outcome))
        arrows += [(key, *e) for e in edges]
    return spark.createDataFrame(
        nodes, "key string, name string, observed boolean, varying boolean, is_outcome boolean"
    ), spark.createDataFrame(arrows, "key string, cause string, effect string, lagged boolean")


def test_verdicts_match_known_graphs(spark):
    rows = list(cases())
    assert len(rows) > 60
    got = {(r.key, r.treatment): r for r in identify.effects(*tables(spark, rows)).collect()}
    wrong = []
    for key, _, _, _, _, expected in rows:
        for e in expected:
            if "⊣" in e:
                u, t = e.split("⊣")[1], e.split("⊣")[0]
                ok = u in got[key, t].blockers
            else:
                t, verdict = e.split(":")
                ok = (key, t) in got and got[key, t].identifiable == (verdict == "ID")
            if not ok:
                wrong.append((key, e, got.get((key, t))))
    assert not wrong


def test_methods_and_instruments(spark):
    rows = [
        ("front", "Y", [("X", "M", False), ("M", "Y", False), ("U", "X", False), ("U", "Y", False)], {"X", "M", "Y"}, set(), []),
        ("iv", "Y", [("Z", "X", False), ("X", "Y", False), ("U", "X", False), ("U", "Y", False)], {"X", "Z", "Y"}, set(), []),
        ("hidden", "Y", [("X", "Y", False)], {"X"}, set(), []),
        ("cycle", "Y", [("X", "Y", False), ("Y", "X", False)], {"X", "Y"}, set(), []),
        ("bow", "Y", [("X", "Y", False), ("U", "X", False), ("U", "Y", False), ("W", "X", False)], {"X", "Y"}, set(), []),
        ("alone", "Y", [("Y", "Q", False)], {"Y"}, set(), []),
    ]
    nodes, arrows = tables(spark, rows)
    verdicts = identify.effects(nodes, arrows)
    got = {(r.key, r.treatment): r for r in verdicts.collect()}
    assert got["front", "X"].method == "do_calculus" and got["front", "X"].marginalized == ["U"]
    assert got["iv", "X"].method == "instrumental_variable" and got["iv", "X"].instruments == ["Z"] and got["iv", "Z"].method == "do_calculus"
    assert got["hidden", "X"].note == "outcome is unobserved" and not got["cycle", "X"].identifiable
    assert got["bow", "X"].blockers == ["U"] and not [k for k in got if k[0] == "alone"]
    roles = {(r.key, r.construct): r for r in identify.unobserved_roles(nodes, verdicts).collect()}
    assert roles["bow", "U"].blocks == ["X"] and roles["bow", "W"].can_marginalize and roles["bow", "W"].reason == "does not confound"
    assert roles["front", "U"].reason == "handled by the identification"
    assert {(r.key, r.construct) for r in identify.to_fix(nodes, verdicts).collect()} == {("bow", "U"), ("hidden", "Y")}
    assert {r.key: (r.constructs, r.edges, r.outcome) for r in identify.summary(nodes, arrows).collect()}["iv"] == (4, 4, "Y")


def test_projection_keeps_directed_paths_through_hidden_nodes():
    direct, both = identify.project({("a", "h"), ("h", "b"), ("h", "c"), ("k", "h"), ("b", "d")}, {"a", "b", "c", "d"})
    assert direct == {("a", "b"), ("a", "c"), ("b", "d")} and both == {("b", "c")}


def test_a_bad_graph_is_a_row_and_not_an_error(spark):
    nodes = [("none", "A", True, True, False), ("two", "A", True, True, True), ("two", "B", True, True, True), ("good", "A", True, True, False), ("good", "B", True, True, True)]
    constructs = spark.createDataFrame(nodes, "key string, name string, observed boolean, varying boolean, is_outcome boolean")
    edges = spark.createDataFrame([(k, "A", "B", True) for k in ("none", "two", "good")], "key string, cause string, effect string, lagged boolean")
    got = {(r.key, r.treatment): (r.identifiable, r.note) for r in identify.effects(constructs, edges).collect()}
    assert got == {("none", None): (False, "0 outcomes"), ("two", None): (False, "2 outcomes"), ("good", "A"): (True, None)}


#: Textbook graphs: name, edges (> within a time step, >> into the next), hidden and invariant constructs, and what is
#: known of each treatment's effect on Y: by do-calculus, by an instrument, or not at all for the constructs named.
TEXTBOOK = [
    ("chain", "X>M M>Y", "", "", {"X": "do", "M": "do"}),
    ("back door", "Z>X Z>Y X>Y", "", "", {"X": "do", "Z": "do"}),
    ("bow", "X>Y U>X U>Y", "U", "", {"X": "U"}),
    ("front door", "X>M M>Y U>X U>Y", "U", "", {"X": "do", "M": "do"}),
    ("instrument", "Z>X X>Y U>X U>Y", "U", "", {"X": "iv Z", "Z": "do"}),
    ("invalid instrument", "Z>X Z>Y X>Y U>X U>Y", "U", "", {"X": "U", "Z": "do"}),
    ("m", "U>A A>X V>B B>Y X>Y", "U V", "", {"X": "do", "A": "do", "B": "do"}),
    ("lagged confounder", "X>Y U>>X U>>Y", "U", "", {"X": "U"}),
    ("staggered confounder", "X>Y U>>X U>Y", "U", "", {"X": "do"}),
    ("trait", "T>X T>Y X>Y", "T", "T", {"X": "T"}),
    ("seen trait", "T>X T>Y X>Y", "", "T", {"X": "do", "T": "do"}),
    ("kite", "X>M M>Y U>X U>M V>M V>Y", "U V", "", {"X": "U", "M": "iv X"}),
    ("feedback", "X>Y Y>>X", "", "", {"X": "do"}),
    ("panel with trait", "T>X T>Y X>Y X>>Y Y>>X", "T", "T", {"X": "T"}),
]


def test_textbook_graphs(spark):
    rows = []
    for key, edges, hidden, fixed, _ in TEXTBOOK:
        own = [(*e.replace(">>", ">").split(">"), ">>" in e) for e in edges.split()]
        names = {x for e in own for x in e[:2]}
        rows.append((key, "Y", own, names - set(hidden.split()), set(fixed.split()), None))
    nodes, arrows = tables(spark, rows)
    verdicts = identify.effects(nodes, arrows)
    got = {(r.key, r.treatment): (r.method, r.instruments, r.blockers) for r in verdicts.collect()}
    known = {(key, t): how.split() for key, *_, of in TEXTBOOK for t, how in of.items()}
    method = {"do": identify.DO, "iv": identify.IV}
    assert got == {k: (method.get(how[0]), how[1:] if how[0] == "iv" else [], [] if how[0] in method else how) for k, how in known.items()}
    blocks = {(key, h): sorted(t for (k, t), how in known.items() if k == key and how[0] not in method and h in how) for key, _, hidden, _, _ in TEXTBOOK for h in hidden.split()}
    roles = {(r.key, r.construct): (r.can_marginalize, r.blocks) for r in identify.unobserved_roles(nodes, verdicts).collect()}
    assert roles == {k: (not b, b) for k, b in blocks.items()}
    assert {(r.key, r.construct) for r in identify.to_fix(nodes, verdicts).collect()} == {k for k, b in blocks.items() if b}


def test_sets_as_bits_match_sets():
    """Projection, districts and identification of random graphs, with hidden, invariant and unknown constructs."""
    r = random.Random(5)
    for _ in range(300):
        names = [f"x{i}" for i in range(r.randint(2, 6))]
        observed, varying = [r.random() < 0.6 for _ in names], [r.random() < 0.7 for _ in names]
        arrows = [(*sorted(r.sample([*names, "y1", "a"], 2), reverse=r.random() < 0.1), r.random() < 0.4) for _ in range(r.randint(1, 10))]
        seen_names, moving = ({n for n, x in zip(names, flags) if x} for flags in (observed, varying))
        edges, seen, _ = identify.two_steps(moving, seen_names, arrows, set(names))
        g = identify.Bits(names, observed, varying, arrows)
        node = lambda i: names[i // 2] + (("_t", "_{t-1}")[i % 2] if names[i // 2] in moving else "")
        assert {(node(a), node(b)) for a, x in enumerate(g.steps) for b in identify.bits(x)} == edges
        assert {node(i) for i in identify.bits(g.seen)} == seen
        following = identify.turned(edges)
        assert g.cyclic() == any(n in identify.reach(following.get(n, ()), following) for n in following)
        if g.cyclic():
            continue
        direct, both = identify.project(edges, seen)
        g.project()
        assert {(node(a), node(b)) for b, x in enumerate(g.causes) for a in identify.bits(x)} == direct
        assert {tuple(sorted((node(a), node(b)))) for b, x in enumerate(g.joined) for a in identify.bits(x)} == both
        nodes = list(identify.bits(g.seen))
        for a in nodes:
            for b in nodes:
                assert a == b or g.identified(a, b) == identify.identified(node(a), node(b), direct, both, seen)


def test_graphs_are_dealt_out_by_name(spark):
    """Small tables can be much work: verdicts are made in as many parts as the session names, not in one."""
    nodes = spark.range(200).selectExpr("id AS key", "explode(array('a', 'b')) AS name").selectExpr("*", "true AS observed", "true AS varying", "name = 'b' AS is_outcome")
    arrows = spark.range(200).selectExpr("id AS key", "'a' AS cause", "'b' AS effect", "false AS lagged")
    made = identify.effects(nodes, arrows)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and made.count() == 200
