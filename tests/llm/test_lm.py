import zlib
from collections import Counter
from math import log10

import numpy as np
import pandas as pd
import pytest

from tideline.llm import bloom, lm
from tideline.llm import text as tx
from tideline.llm.queries import op5_lm


def words(content):
    return (content or "").encode().lower().split()


def test_filter_counts_are_within_their_level():
    r = np.random.default_rng(1)
    keys = bloom.mix(np.arange(4000, dtype=np.uint64))
    counts = r.integers(1, 5000, 4000)
    raw = np.zeros(bloom.SEGMENTS * 4096, np.uint8)
    f = bloom.Filter(raw)
    for j in range(1, 14):
        for base, spot in [((keys[bloom.levels(counts) >= j] >> np.uint64(56)) * np.uint64(f.segment_bits), s) for s in bloom.spots(keys[bloom.levels(counts) >= j], j, f.segment_bits)]:
            at = base + spot
            np.bitwise_or.at(raw, (at >> np.uint64(3)).astype(int), (1 << (at & np.uint64(7))).astype(np.uint8))
    assert (f.level(keys) >= bloom.levels(counts)).all()
    assert (f.level(keys) == bloom.levels(counts)).mean() > 0.97
    assert (f.level(bloom.mix(np.arange(9000, 29000, dtype=np.uint64))) > 0).mean() < 0.05


def test_word_splitting_matches_bytes_split():
    import pyarrow as pa

    texts = ["", None, " a  B\t\x0b\x0c\r\nc ", "\x1cé\xa0É x\x85", " ", "Ä ä"]
    w = tx.words(pa.array(texts))
    vocab = w.vocab.to_pylist()
    for i, t in enumerate(texts):
        assert [vocab[c].encode() for c in w.codes[w.offsets[i] : w.offsets[i + 1]]] == words(t)


ROWS = [(i, f"the w{i % 7} of The w{i % 5}\nand w{i}", "x", i) for i in range(60)]
ROWS += [(60, None, "x", 1), (61, "", "x", 1), (None, "the the", "y", 1), (5, ROWS[5][1], "x", 5), (62, "z " * 20000, "x", 1)]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lm")
    spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, times int").repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.mark.parametrize("frequent", [1 << 18, 3])
def test_base_score_matches_brute_force(spark, stored, frequent, monkeypatch):
    monkeypatch.setattr(lm.probe, "__defaults__", (frequent,))
    got = op5_lm(spark, stored).toPandas()
    c = Counter()
    for d, t, *_ in ROWS:
        if d is not None and not held(d):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(words(t)) + 1, sum(c[x] > 0 for x in [*words(t), None]), n, round(sum(log10((c[x] + 1) / (n + v + 1)) for x in [*words(t), None]), 6)) for d, t, *_ in ROWS)
    have = sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples())
    assert have == want
    assert (got.score <= 0).all() and np.isfinite(got.score).all()


def middle(c):
    j = c.bit_length() - 1
    return (2**j + 2 ** (j + 1) - 1) / 2 if c else 0.0


def by_hand(rows):
    """(doc_id, score) of every row: exact counts at the middles of their levels, one weight for each level of the word
    before, 25 rounds of expectation-maximisation over the tokens of the training rows one after another."""
    tokens = [[*words(t), None] for _, t, *_ in rows]
    learnt = [k for k, (d, *_) in enumerate(rows) if d is not None and not held(d)]
    single, pair = Counter(), Counter()
    for k in learnt:
        single.update(tokens[k])
        pair.update(zip([None, *tokens[k]], tokens[k]))
    m, v = sum(middle(c) for c in single.values()), len(single)

    def counts(before, own):
        a, b, c = middle(single[before]), middle(single[own]), middle(pair[before, own])
        return a, b, min(a, b, c)

    weight = {}
    for _ in range(25):
        share, size = Counter(), Counter()
        for k in learnt:
            for before, own in zip([None, *tokens[k]], tokens[k]):
                a, b, c = counts(before, own)
                x = weight.get(a, 0.5) * max(c - 1, 0) / max(a - 1, 1)
                y = (1 - weight.get(a, 0.5)) * max(b, 1) / (m + v + 1)
                share[a] += x / (x + y)
                size[a] += 1
        weight = {a: min(max((share[a] + 1) / (size[a] + 4), 0.02), 0.98) for a in size}
    out = []
    for (d, *_), own in zip(rows, tokens):
        total = 0.0
        for before, now in zip([None, *own], own):
            a, b, c = counts(before, now)
            w = weight.get(a, 0.25) if a else 0.0
            total += log10(w * c / max(a, 1) + (1 - w) * (b + 1) / (m + v + 1))
        out.append((str(d), round(total, 4)))
    return sorted(out)


@pytest.mark.parametrize("max_bytes", [1 << 22, 1 << 9])
def test_score_matches_brute_force_whether_or_not_the_filter_takes_all(spark, stored, max_bytes, monkeypatch):
    """With 64 bits an entry the filter hardly errs. The small one leaves bigrams to the join."""
    monkeypatch.setattr(lm.count, "__defaults__", (max_bytes, 64, 0))
    docs = spark.read.parquet(f"{stored}/documents.parquet")
    model, counts = lm.count(docs.where("doc_id is not null").where(~docs.doc_id.isin([d for d, *_ in ROWS if held(d)])))
    assert (model.rare is None) == (max_bytes > 1 << 20) and (model.rare is None or model.rare.count() > 20)
    got = op5_lm(spark, stored).toPandas()
    assert sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), round(r.score, 4)) for r in got.itertuples()) == by_hand(ROWS)


def test_held_out_score_beats_base(spark):
    got = op5_lm(spark, "/root/testdata/sf0.001").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op5_lm(spark, str(tmp_path)).count() == 0


def test_bigrams_take_little_memory_beside_their_batch(spark, stored, monkeypatch):
    """One batch of 10 MB of text, as a task's function sees it: what numpy and Python take beyond it at the most."""
    import tracemalloc

    import pyarrow as pa

    docs, taken = spark.read.parquet(f"{stored}/documents.parquet"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema, *a: taken.append(run))
    lm.bigram_parts(docs, 8)
    r = np.random.default_rng(3)
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(map(str, r.integers(0, 20000, 400).tolist())) for _ in range(4400)]})
    tracemalloc.start()
    keys = sum(len(bloom.from_planes(k)) for out in taken[0](iter([batch])) for k in out.column(1).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys > 1_000_000 and peak < 80e6


def test_all_bits_of_a_key_lie_in_one_block():
    keys, bits = bloom.mix(np.arange(3000, dtype=np.uint64)), 16 * bloom.BLOCK_BITS
    at = np.array([s for j in range(1, 21) for s in bloom.spots(keys, j, bits)]).astype(np.int64)
    block = at // bloom.BLOCK_BITS
    assert (block == block[0]).all() and set(block[0]) == set(range(16))
    assert np.mean([len(np.unique(x)) for x in at.T]) > 75  # of 80


def test_word_hashes_are_those_of_the_bytes():
    """Whatever words lie before and behind, whether or not the array is a slice, and for words of any length."""
    import pyarrow as pa

    vocab = sorted({"x" * k + y for k in (0, 1, 6, 7, 8, 9, 15, 16, 17, 62, 63, 64, 65, 500) for y in ("a", "b", "é", "\x00", "\x00\x00")})
    alone = [int(lm.word_hashes(pa.array([x]))[0]) for x in vocab]
    assert len(set(alone)) == len(vocab)
    assert lm.word_hashes(pa.array(vocab)).tolist() == alone
    assert lm.word_hashes(pa.array(["zz", *vocab, "y" * 90]).slice(1, len(vocab))).tolist() == alone
    assert lm.word_hashes(pa.array([x.encode() for x in vocab], pa.binary())).tolist() == alone
    assert len(lm.word_hashes(pa.array([], pa.string()))) == 0


def test_hashing_and_reading_counts_cost_little_beside_taking_words_apart():
    """CPU time for the words and the bigrams of a batch, in units of what splitting its texts takes."""
    import time

    import pyarrow as pa

    def took(f):
        def once():
            began = time.process_time()
            f()
            return time.process_time() - began

        return min(once() for _ in range(4))

    r = np.random.default_rng(3)
    texts = pa.array([" ".join(f"word{x}" for x in row) for row in (150_000 * r.random((1000, 400)) ** 3).astype(int).tolist()])
    w = tx.words(texts)
    keys = bloom.mix(np.arange(len(w.codes), dtype=np.uint64))
    deep = r.geometric(0.25, len(keys))
    raw = np.zeros(64 * len(keys) // 8 // (1 << 16) * (1 << 16), np.uint8)
    bits = np.uint64(len(raw) // bloom.SEGMENTS * 8)
    for j in range(1, deep.max() + 1):
        some = keys[deep >= j]
        for spot in bloom.spots(some, j, int(bits)):
            at = (some >> np.uint64(56)) * bits + spot
            np.bitwise_or.at(raw, (at >> np.uint64(3)).astype(int), (1 << (at & np.uint64(7))).astype(np.uint8))
    f = bloom.Filter(raw)
    assert (f.level(keys) >= deep).all() and (f.level(keys) == deep).mean() > 0.97
    unit = took(lambda: tx.words(texts))
    assert took(lambda: lm.word_hashes(w.vocab)) + took(lambda: f.level(keys)) < 4.5 * unit
