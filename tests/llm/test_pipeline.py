"""Each stage of the pipeline against a plain version, on the rows that the stage before kept."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_linededup import stretches
from tests.llm.test_similar import shingles
from tideline.llm import quality
from tideline.llm.queries import WORD_BPE
from tideline.llm.spark_io import cut

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "_d", "_n", "_h", "score"]


def corpus(r):
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(k, line(n)) for k, n in enumerate([30, 45, 60])]
    passage = [line(22) for _ in range(3)]
    docs, labels = [], []
    for k in range(150):
        bad = k % 5 == 0
        body = [line(r.randint(6, 20)) for _ in range(8)] if not bad else [" ".join(r.choice(["$$$", "CLICK!!", "%%%", "###"]) for _ in range(20)) for _ in range(5)]
        if k % 15 == 1:
            body[3:3] = passage
        if k % 15 == 2:
            body[2:2] = [items[k % 3][1]]
        docs.append([k, "\n".join(body), "en", "spam" if bad else "web"])
        if k < 60:
            labels.append((k, int(not bad), 0))
    for k in range(20):
        d, text, *rest = docs[r.choice([i for i in range(150) if i % 5])]
        ws = text.split(" ")
        if k % 2:
            ws[r.randrange(len(ws))] = "edited"
        docs.append([1000 + k, " ".join(ws), *rest])
    docs += [[2000, None, "en", "web"], [2001, "", "en", "web"], [None, docs[7][1], "en", "web"], list(docs[8])]
    return [(*d, len(d[1] or ""), 1, 2, 3, "x") for d in docs], labels, items


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage, and what comes out of the last."""
    docs, labels, items = corpus(random.Random(21))
    path = tmp_path_factory.mktemp("pipeline")
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, _d int, _n int, _h int, score string")
    rows.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
    out = [spark.read.parquet(str(path / "documents.parquet"))]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], str(path))))
    return [df.columns for df in out], [[tuple(r) for r in df.collect()] for df in out], labels, items, str(path)


def key(rows):
    return sorted(map(str, rows))


def test_columns_stay(stages):
    names, *_ = stages
    assert names[:-1] == [NAMES] * 5 and set(names[-1]) == {*NAMES, "token_ids", "n_tokens"}


def test_quality_keeps_what_the_model_does_not_reject(spark, stages):
    _, rows, labels, _, path = stages
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    table = docs.select("text", "lang", "source", "n_chars").toArrow()
    score = model.scores(quality.Rows.read(table.combine_chunks().to_batches()[0]))[0]
    want = [tuple(r) for r, s in zip(docs.collect(), score) if s >= quality.THRESHOLD]
    assert key(rows[1]) == key(want)
    assert not any(r[3] == "spam" for r in rows[1]) and sum(r[3] == "web" for r in rows[1]) > 0.95 * sum(r[3] == "web" for r in rows[0])


def test_line_dedup_takes_out_later_copies(stages):
    _, rows, *_ = stages
    before, after = rows[1], {(r[0], *r[2:4]): r for r in rows[2] if r[0] is not None}
    gone = stretches([(r[0], r[1]) for r in {r[0]: r for r in before if r[0] is not None and r[1] is not None}.values()])
    assert sum(map(len, gone.values())) > 20
    for r in before:
        if r[0] is None or r[1] is None:
            assert r in rows[2]
            continue
        left = [x for i, x in enumerate(r[1].split("\n")) if i not in gone[r[0]]]
        now = after.get((r[0], *r[2:4]))
        if now is None:
            assert not "".join(left).split() or r[0] >= 1000
            continue
        assert set(now[1].split("\n")) <= set(left) and now[4] == len(now[1])


def test_near_dedup_keeps_one_of_each_group(stages):
    _, rows, *_ = stages
    before = rows[2]
    sets, group = [shingles(r[1]) for r in before], list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    heads = {}
    for r, g in zip(before, group):
        heads[g] = min(heads.get(g, 1 << 60), 1 << 59 if r[0] is None else r[0])
    assert sorted(1 << 59 if r[0] is None else r[0] for r in rows[3]) == sorted(heads.values())
    assert len(rows[3]) < len(before) and set(rows[3]) <= set(before)


def test_decontamination_drops_matches(stages):
    _, rows, _, items, _ = stages
    hit = {d for d, _ in contaminated([r[:2] for r in rows[3]], items)}
    assert hit and key(rows[4]) == key(r for r in rows[3] if r[0] not in hit)


def test_encoding_matches_the_library(stages):
    names, rows, *_ = stages
    library = Tokenizer.from_file(WORD_BPE)
    ids, n = names[5].index("token_ids"), names[5].index("n_tokens")
    assert len(rows[5]) == len(rows[4])
    for r in rows[5]:
        want = library.encode(r[1] or "", add_special_tokens=False).ids
        assert list(r[ids]) == want and r[n] == len(want)


def test_run_chains_the_stages(spark, stages):
    names, rows, *_, path = stages
    got = corpus_pipeline.run(spark, path)
    assert key(tuple(r) for r in got.select(*names[5]).collect()) == key(rows[5])
