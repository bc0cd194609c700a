import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.llm import linededup
from tideline.llm.linededup import ends, runs


def brute(rows):
    """The same passages from all pairs of lines: no hashes of runs, no joins."""
    docs = sorted({(d, t) for d, t, *_ in rows if d is not None and t is not None}, key=lambda x: x[0])
    own = {k: runs(k[1]) for k in docs}
    lines = {k: k[1].split("\n") for k in docs}
    first = {}
    for k in docs:
        for _, i, n, _ in own[k]:
            key = tuple(lines[k][i : i + n])
            first[key] = min(first.get(key, (k[0], i, k)), (k[0], i, k))
    gone = defaultdict(set)
    for k in docs:
        groups = defaultdict(dict)
        for _, i, n, strong in own[k]:
            d, at, to = first[tuple(lines[k][i : i + n])]
            if (to, at) != (k, i):
                for j in range(i, i + n):
                    g = groups[to, at - i]
                    g[j] = g.get(j, False) or strong
        for g in groups.values():
            island = []
            for j in [*sorted(g), None]:
                if island and (j is None or j != island[-1] + 1):
                    if any(g[x] for x in island):
                        gone[k].update(island)
                    island = []
                if j is not None:
                    island.append(j)
    return {k: "\n".join(x for i, x in enumerate(lines[k]) if i not in gone[k]) for k in docs}


def make(n, seed):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.choice([1, 4, 8, 15, 55])))
    passages = [[line() for _ in range(r.randint(1, 6))] for _ in range(6)]
    rows = []
    for i in range(n):
        body = [line() for _ in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(body))
            body[at:at] = r.choice(passages)
        rows.append((i * 13 % 211, "\n".join(body), "x", 5))
    return rows


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, hash string, lines_removed int").repartition(3)
    got = linededup.dedupe(docs)
    assert got.columns == ["doc_id", "text", "hash", "lines_removed"]
    want = brute(rows)
    expected = sorted(str((d, want.get((d, t), t))) for d, t, *_ in rows)
    assert sorted(str((g.doc_id, g.text)) for g in got.collect()) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = make(80, seed)
    rows += [
        rows[3], rows[3], (900, None, "x", 1), (901, "", "x", 1), (None, rows[0][1], "x", 1), (902, "\n\n\n", None, 1),
        (903, rows[5][1] + "\n" + rows[5][1], "x", 1), (904, "w " * 40000 + "\n" + "v " * 60, "", 0), (905, "u\n" + "v " * 60, "", 0),
        (rows[7][0], "same id\nother text " * 30, "", 0)
    ]
    check(spark, rows)


def test_a_passage_goes_wherever_it_starts_and_its_ends_with_it(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = [line(18) for _ in range(4)]
    rows = []
    for i in range(30):
        body = [line(9) for _ in range(8)]
        at = r.randint(0, 8)
        body[at:at] = passage
        rows.append((i, "\n".join(body), "x", 0))
    got = {g.doc_id: g for g in linededup.dedupe(spark.createDataFrame(rows, "doc_id bigint, text string, hash string, x int")).collect()}
    assert got[0].text == rows[0][1]
    left = sum(p in got[i].text for i in range(1, 30) for p in passage)
    assert left == 0 and all(len(got[i].text.split("\n")) == 8 for i in range(1, 30))


def test_boundaries_shift_with_the_lines():
    r = random.Random(7)
    h = [r.getrandbits(64) for _ in range(200)]
    a, b = ends(h), ends([1, 2, 3, *h])
    assert len(set(x + 3 for x in a) & set(b)) > 0.8 * len(a)
    assert ends([]) == [] and ends(h)[-1] == 200


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert linededup.dedupe(empty).count() == 0


def test_clean_documents_stay(spark):
    rows = [(i, f"unique line {i}\nAll rights reserved.\nanother {i * 7}", "x", 0) for i in range(20)]
    got = linededup.dedupe(spark.createDataFrame(rows, "doc_id bigint, text string, hash string, x int"))
    assert got.where(F.col("lines_removed") > 0).count() == 0


def stretches(rows):
    """Lines of each text that lie in several lines of over 50 words that an earlier text has too: no chunks, no hashes."""
    out = defaultdict(set)
    lines = {d: t.split("\n") for d, t in rows}
    for d, own in lines.items():
        for other in (x for k, x in lines.items() if k < d):
            for i in range(len(own)):
                for j in range(len(other)):
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    while n and not own[i + n - 1].split():
                        n -= 1
                    if n > 1 and own[i].split() and sum(len(x.split()) for x in own[i : i + n]) > 50:
                        out[d].update(range(i, i + n))
    return out


def test_passages_found_without_chunks_go_whole(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    shapes = [[33, 34], [49, 25, 14, 2], [4, 47], [26, 26], [30, 0, 30], [20, 25, 30], [9] * 6, [6] * 9, [5] * 12, [1] * 60] * 6
    passages = [[line(n) for n in shape] for shape in shapes]
    rows = [(0, "\n".join([passages[2][0], line(9), passages[22][0]]))]
    for copy in range(3):
        for p in passages:
            body = [line(9) for _ in range(4)]
            at = r.randint(0, 4)
            body[at:at] = p if copy < 2 else p + r.choice(passages)[:3]
            rows.append((len(rows), "\n".join(body)))
    want = stretches(rows)
    got = {g.doc_id: g.text.split("\n") for g in linededup.dedupe(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for d, t in rows:
        kept = [x for i, x in enumerate(t.split("\n")) if i not in want[d]]
        assert got[d] == kept or sum(map(len, got[d])) < sum(map(len, kept)), d
    assert {x for x in "\n".join(t for _, t in rows).split("\n") if x} == {x for own in got.values() for x in own if x}


@pytest.mark.parametrize("seed", [3, 4])
def test_what_goes_is_repeated_and_what_is_long_and_repeated_goes(spark, seed):
    """By comparing lines alone: a line goes only within a run that stands earlier too and has 20 words in several lines
    or a line of 50; every earlier run of several lines with over 50 words, and every line of 50, goes."""
    rows = [(d, t) for d, t, *_ in {d: (d, t) for d, t, *_ in make(60, seed)}.values()]
    lines = {d: t.split("\n") for d, t in rows}
    may, must = defaultdict(set), stretches(rows)
    for d, own in lines.items():
        for other in [x for k, x in lines.items() if k <= d]:
            for i in range(len(own)):
                for j in range(len(other) if other is not own else i):
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    words = [len(x.split()) for x in own[i : i + n]]
                    if n > 1 and sum(words) >= 20 or any(w >= 50 for w in words):
                        may[d].update(range(i, i + n))
                    must[d].update(i + k for k, w in enumerate(words) if w >= 50)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    gone = linededup.repeated_runs(docs).collect()
    went = defaultdict(set)
    for g in gone:
        went[g.doc_id].update(range(g.start, g.start + g.lines))
    assert sum(map(len, went.values())) > 20
    for d in lines:
        assert went[d] <= may[d] and {i for i in must[d] if lines[d][i].split()} <= went[d]


def test_columns_of_any_name_stay(spark):
    text = "\n".join(f"word{k} " * 30 for k in range(4))
    rows = [(k, text, 1, 2, 3, "x") for k in (1, 2)]
    got = linededup.dedupe(spark.createDataFrame(rows, "doc_id bigint, text string, _d int, _t int, _gone int, _left string"))
    assert got.columns == ["doc_id", "text", "_d", "_t", "_gone", "_left", "lines_removed"]
    assert sorted(tuple(x) for x in got.collect()) == [(1, text, 1, 2, 3, "x", 0), (2, "", 1, 2, 3, "x", 4)]


def test_every_line_of_a_long_passage_lies_in_a_span_of_it():
    r = random.Random(12)
    for _ in range(300):
        words = [r.choice([0, 1, 3, 9, 20, 49, 60]) for _ in range(r.randint(2, 30))]
        found = linededup.spans(words)
        i, j = sorted(r.sample(range(len(words)), 2))
        if words[i] and words[j] and sum(words[i : j + 1]) > 50:
            covered = {x for a, b in found if i <= a and b <= j for x in range(a, b + 1)}
            assert covered >= {x for x in range(i, j + 1) if 0 < words[x] <= 50}
