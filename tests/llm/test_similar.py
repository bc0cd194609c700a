import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import neardup, similar


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Smallest id of each component, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                comp[find(i)] = find(j)
    return sorted({min(rows[k][0] for k in range(len(rows)) if find(k) == find(i)) for i in range(len(rows))})


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    out = []
    for n in [3, 4, 5, 9, 40, 60, 100, 100, 200, 400, 1000]:
        base = [word() for _ in range(n)]
        out.append(" ".join(base))
        for edits in [0, 1, 1, 2, n // 50 + 1, n // 40 + 1, n // 25 + 1, n // 10]:
            w = list(base)
            for _ in range(edits):
                w[r.randrange(n)] = word()
            out.append(" ".join(w))
    r.shuffle(out)
    return [(i * 7 % 1009, t) for i, t in enumerate(out)] + [(2000, ""), (2001, None)]


def kept(docs):
    return sorted(r.doc_id for r in corpus_pipeline.one_of_each(docs.sparkSession, docs, "").collect())


def test_the_stage_keeps_one_of_each_similar_group(spark):
    for seed in (1, 2):
        rows = texts(seed)
        assert kept(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == brute(rows)


def test_fingerprints_join_what_no_band_shows(spark, monkeypatch):
    """Links by SimHash are the stage's own: without any band, texts within its radius and of the similarity are joined."""
    none = lambda classes, *_: classes.select(F.lit(0).alias("kind"), F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    monkeypatch.setattr(similar, "candidates", none)
    rows = texts(5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    sets = [similar.shingle_set(t) for _, t in rows]
    bits = neardup.majority(np.concatenate(sets), np.array([len(s) for s in sets]))
    group = list(range(len(rows)))
    close = lambda i, j: 0 < len(sets[j]) and similar.shared(sets[i], sets[j]) >= 0.8 and (bits[i] ^ bits[j]).bit_count() <= neardup.RADIUS
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i]) and close(i, j)]
    assert sum(set(sets[i]) != set(sets[j]) for i, j in linked) > 10
    for i, j in linked:
        group = [group[j] if g == group[i] else g for g in group]
    lowest = {g: min(d for (d, _), x in zip(rows, group) if x == g) for g in group}
    got = {r.doc_id: r.component_id for r in similar.cluster(docs).collect()}
    assert got == {d: lowest[g] for (d, t), g in zip(rows, group) if d < 2000} | {2000: 2000, 2001: 2000}


@pytest.mark.parametrize("block", [similar.BLOCK, 1500])
def test_crowded_bands_are_linked_exactly(spark, block, monkeypatch):
    monkeypatch.setattr(similar.crowd_links, "__defaults__", (block,))
    rows = texts(3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = similar.cluster(docs, crowd=3)
    assert sorted(r.component_id for r in found.select("component_id").distinct().collect()) == brute(rows)


def test_a_crowd_of_chains_is_linked_across_blocks(spark, monkeypatch):
    """Crowds of texts each like the next but not like those further on, so that no leader joins most of them."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    members = []
    for root in range(3):
        own = [word() for _ in range(60)]
        for k in range(40):
            members.append((root, len(members), sorted(neardup.shingle_hashes(" ".join(own), 5))))
            own[(k * 7) % 60] = word()
    df = spark.createDataFrame([(a, b, [h - (1 << 64) if h >> 63 else h for h in own]) for a, b, own in members], "root bigint, fp bigint, own array<bigint>").repartition(4)
    group = list(range(len(members)))

    def join(pairs):
        group[:] = range(len(members))
        for a, b in pairs:
            old, new = group[a], group[b]
            group[:] = [new if g == old else g for g in group]
        return {frozenset(i for i, g in enumerate(group) if g == x) for x in group}

    alike = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    want = join([(i, j) for r1, i, a in members for r2, j, b in members[:i] if r1 == r2 and alike(a, b)])
    assert 3 < len(want) or max(map(len, want)) > 10
    for block in (similar.BLOCK, 700):
        got = similar.crowd_links(df, 0.8, block).collect()
        assert join([(g.a, g.b) for g in got]) == want and len(got) < 12 * len(members)


def test_rows_without_id_or_rows(spark):
    rows = [(None, "alone without an id at all"), (None, "Alone without an id at all"), (4, "four words and one more here"), (4, "four words and one more here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == ["4", "None"]
    assert corpus_pipeline.one_of_each(spark, docs.where("false"), "").count() == 0
