"""Codes against a plain form of the rounds, in which every distance is computed."""

import hashlib

import numpy as np
import pytest

from tests.compare import connect, differences
from tideline.llm import queries, vectorcode

SF = "/root/testdata/sf0.001"


def plain(vectors, parts, entries, rounds, scale):
    """[(code, error)] and the entries, by loops over whole numbers. vectors: in the order of their ids."""
    xs = [[int(np.floor(scale * float(v))) for v in row] for row in vectors]
    w = len(xs[0]) // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for x in xs]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p]) for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own) if o == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    out = []
    for c in cut:
        own = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((own, sum(far(c[p], books[p][own[p]]) for p in range(parts))))
    return out, books


def compressed(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, x string, own int, c0 int")
    coded = vectorcode.compress(df.repartition(3), **how)
    assert coded.rows.columns[:2] == ["vec_id", "label"]
    return coded


@pytest.mark.parametrize("seed, digits", [(0, 3), (1, 1), (2, 0)])
def test_equals_plain_rounds(spark, seed, digits):
    """Few digits make ties of distances and of vectors."""
    rng = np.random.default_rng(seed)
    made = np.round(rng.standard_normal((120, 8)) * (3 if digits == 0 else 1), digits)
    made[50:60] = made[40]
    how = {"parts": 4, "entries": 16, "rounds": 4, "scale": 64 if digits else 1}
    rows = [(i, i % 3, v, "", i, i) for i, v in enumerate(made.tolist())]
    coded = compressed(spark, rows, **how)
    want, books = plain(np.float32(made), **how)
    got = {r.vec_id: r for r in coded.rows.toDF("vec_id", "label", "x", "own", "c0", "code", "error").collect()}
    assert {k: (list(np.frombuffer(bytes(r.code), "<u2")), r.error) for k, r in got.items()} == {i: w for i, w in enumerate(want)}
    assert coded.books.now.tolist() == books
    assert {k: (r.x, r.own, r.c0) for k, r in got.items()} == {i: ("", i, i) for i in range(120)}


def test_nulls_repeats_and_few_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, None, v, "a", 1, 1), (1, None, v, "a", 1, 1), (None, 2, [0.5] * 4, None, None, None), (4, 1, None, "", 0, 0)]
    rows += [(5, 1, [1.0, None, 1.0, 1.0], "", 0, 0), (6, 1, [1.0, float("nan"), 1.0, 1.0], "", 0, 0), (7, 1, [float("inf")] * 4, "", 0, 0)]
    coded = compressed(spark, rows)
    assert coded.books.now.shape == (4, 3, 1) and coded.books.now[0].ravel().tolist() == [1024, 1024, 512]
    got = sorted((r.vec_id or 0, bytes(r[5]).hex(), r.error) for r in coded.rows.collect())
    assert got == [(0, "0200020002000200", 0), (1, "0000000000000000", 0), (1, "0000000000000000", 0)]
    nobody = compressed(spark, rows[3:])
    assert nobody.rows.count() == 0 and nobody.books.joined() == ""
    digest = vectorcode.digest(spark.createDataFrame(rows[3:], "vec_id long, label int, embedding array<float>, x string, own int, c0 int"))
    assert digest.count() == 0 and digest.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_label_errors_take_nulls_together(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 3 == 0 else i % 3, rng.standard_normal(8).tolist()) for i in range(600)]
    got = vectorcode.digest(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    sums = {}
    for r in got:
        sums[r.vec_id % 3] = sums.get(r.vec_id % 3, 0) + r.error
    assert len(got) == 600 and all(r.label_error == sums[r.vec_id % 3] for r in got) and any(r.error for r in got)
    assert all(len(r.code) == 8 for r in got)
    want, books = plain(np.float32([r[2] for r in rows]), 4, 256, 4, 1024)
    assert {r.vec_id: (r.code, r.error) for r in got} == {i: (bytes(c).hex(), e) for i, (c, e) in enumerate(want)}
    said = ",".join(str(v) for part in books for entry in part for v in entry)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(said.encode()).hexdigest()}


def test_bad_lengths_fail(spark):
    with pytest.raises(ValueError, match="parts"):
        compressed(spark, [(1, 1, [1.0, 2.0, 3.0], "", 0, 0)])
    with pytest.raises(Exception, match="differ in length"):
        compressed(spark, [(1, 1, [1.0] * 4, "", 0, 0), (2, 1, [1.0] * 8, "", 0, 0)])
    assert compressed(spark, [(1, 1, [], "", 0, 0)]).rows.first().error == 0


def test_bounds_hold_and_spare_most_distances():
    """Over rounds of moves: bounds stay on their sides through bytes, choices equal those of all distances, and after the
    first moves most distances are not computed."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (32, 16))
    x = centres[rng.integers(0, 32, 2000)] + rng.integers(-200, 200, (2000, 16))
    entries = x[:32].copy()
    own, _, upper, lower = vectorcode.first(x, entries)
    shares = []
    for _ in range(6):
        before, entries = entries, entries.copy()
        for k in range(32):
            if (own == k).any():
                entries[k] = x[own == k].sum(axis=0) // (own == k).sum()
        own, upper, lower, looked = vectorcode.again(x, entries, before, own, upper, vectorcode.unpacked(*vectorcode.packed(lower)))
        exact = vectorcode.distances(x, entries)
        assert (own == exact.argmin(axis=1)).all()
        assert (upper**2 >= exact[np.arange(2000), own]).all()
        assert (vectorcode.unpacked(*vectorcode.packed(lower)) ** 2 <= exact).all()
        shares.append(looked / exact.size)
    assert shares[-1] < 0.1 and shares[0] < 0.6


def test_large_components_are_exact():
    x = np.array([[1 << 27, -(1 << 27)], [3, 4]])
    assert vectorcode.distances(x, x).tolist() == [[0, ((1 << 27) - 3) ** 2 + ((1 << 27) + 4) ** 2]] * 1 + [[((1 << 27) - 3) ** 2 + ((1 << 27) + 4) ** 2, 0]]


def test_query_equals_sql(spark):
    assert not differences(queries.queries()["op13_vectorcode"](spark, SF), connect(SF), queries.oracles()["op13_vectorcode"])
