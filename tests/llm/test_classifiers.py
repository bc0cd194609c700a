import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import langid, quality, toxicity
from tideline.llm import text as tx
from tideline.llm.queries import op1_quality, op4_toxicity, op6_langid

SMALL = "/root/testdata/sf0.01"
ODD = [(900001, None, None, None, None), (900002, "", "xx", None, 0), (None, "1 2 3 !!! ...", "en", "s", 1), (900003, "wort " * 30000, "de", "s", 2), (900003, "wort " * 30000, "de", "s", 2)]


def odd_tables(spark, tmp_path, labels=()):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(200)
    extra = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.unionByName(extra).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(3)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    known = spark.read.parquet(f"{SMALL}/labels.parquet")
    known.unionByName(spark.createDataFrame([(900001, 1, 0), (None, 0, 1), (900002, None, None), (5, 7, 9)], "doc_id bigint, quality int, toxic int")).write.parquet(str(tmp_path / "labels.parquet"))
    return 205


def test_quality_is_learnt_and_every_row_scored(spark, tmp_path):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = quality.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert ((rows.predicted == rows.quality).mean()) > 0.95
    n = odd_tables(spark, tmp_path)
    got = op1_quality(spark, str(tmp_path)).toPandas()
    assert len(got) == n and got.score.between(0, 1).all()
    docs, known = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    kept = quality.keep(docs, known)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "held_out"]
    want = quality.score(docs, quality.train(docs, known)).where("predicted = 1").select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(str(r.doc_id) for r in want)


def made_up(n=120, known=12):
    """Texts of two kinds with a telling source, the first few of them labelled: docs, labels and every row's kind."""
    r = random.Random(1)
    docs = [(k, " ".join(r.choice(["good", "fine", "well"] if k % 2 else ["BAD!!", "x%%", "y##"]) for _ in range(30)), "ab"[k % 2]) for k in range(n)]
    return docs, [(k, k % 2, 0) for k in range(known)], np.arange(n) % 2


def test_quality_views_learn_from_each_other(spark):
    docs, labels, kind = made_up()
    docs = spark.createDataFrame([*docs, (3, docs[3][1], "b"), (None, docs[5][1], None), (7, "another text", "b")], "doc_id bigint, text string, source string")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), added=10)
    rows = quality.score(docs.where("doc_id is not null and text <> 'another text'").dropDuplicates(["doc_id"]), model).orderBy("doc_id").toPandas()
    assert (rows.predicted == kind).mean() > 0.97


def test_quality_pool_is_every_row_without_a_label(spark):
    """What is picked is what sorting all rows by hand gives, in the first round and in the second."""
    docs, labels, _ = made_up(90)
    docs += [(500, docs[50][1], "a"), (None, "no id", "b"), (501, None, None)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(3)
    seen = quality.features(docs)
    known = spark.createDataFrame([(k, y) for k, y, _ in labels], "doc_id bigint, _y int")
    everything = seen.where("doc_id is not null").orderBy("doc_id").toArrow()
    rows, ids, hashes = quality.Rows.of(everything), everything.column("doc_id").to_pylist(), everything.column("text_hash").to_pylist()
    some = rows.take(np.arange(12))
    content, page = quality.Content.fit(some, np.arange(12) % 2), quality.Page.fit(some, np.arange(12) % 2)
    assert page.logits(rows).shape == (len(ids),)
    pick, used = quality.picker(seen, known), set()
    for _ in range(2):
        free = [i for i in range(len(ids)) if ids[i] > 11 and hashes[i] not in used and hashes[i] not in [hashes[j] for j in range(i) if ids[j] > 11]]
        want = {}
        for teacher, view in enumerate((content, page)):
            v = view.logits(rows)
            want[1 - teacher, 0] = sorted((i for i in free if v[i] < 0), key=lambda i: (v[i], hashes[i]))[:4]
            want[1 - teacher, 1] = sorted((i for i in free if v[i] > 0), key=lambda i: (-v[i], hashes[i]))[:7]
        got = {(learner, label): x for learner, label, x in pick(content, page, 4, 7)}
        used |= {hashes[i] for own in want.values() for i in own}
        for k, own in want.items():
            assert np.allclose(got[k].page, rows.take(np.array(own, int)).page) and got[k].cells.tolist() == rows.take(np.array(own, int)).cells.tolist()


def test_quality_content_learns_as_a_dense_model_does():
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice(["a", "B", "c9", "d.", "e"], 1 + k % 9)) for k in range(50)] + ["", None]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    x, y = quality.Rows.read(batch), (np.arange(52) % 3 == 0).astype(float)
    dense = np.zeros((52, quality.BUCKETS))
    for i, t in enumerate(texts):
        for word in (t or "").split():
            for b in quality.word_features(pa.array([word]))[0]:
                dense[i, b] += 1 / len(t.split())
    w, bias, past, bias_past = np.zeros(quality.BUCKETS), 0.0, np.full(quality.BUCKETS, 1e-8), 1e-8
    shuffle = np.random.default_rng(1)
    for _ in range(2):
        order = shuffle.permutation(52)
        for a in range(0, 52, 32):
            own = order[a : a + 32]
            err = (1 / (1 + np.exp(-(dense[own] @ w + bias))) - y[own]) / len(own)
            grad = dense[own].T @ err
            past += grad**2
            w -= 0.2 * grad / np.sqrt(past)
            bias_past += err.sum() ** 2
            bias -= 0.05 * err.sum() / np.sqrt(bias_past)
    model = quality.Content.fit(x, y, epochs=2)
    assert np.allclose(model.logits(x), dense @ w + bias)


def test_quality_layout_matches_counting_characters():
    texts = ["Ab1 c\n\nAb1 c\n!!", "", None, "É é \u00a0 9%", " \n "]
    got = quality.Rows.read(pa.RecordBatch.from_pydict({"text": texts, "lang": ["x"] * 5})).page
    for t, row in zip(texts, got):
        t = t or ""
        n, ws, ls = max(len(t), 1), t.split(), t.split("\n")
        kinds = [
            sum(c.isupper() for c in t), sum(c.islower() for c in t), sum(c.isnumeric() for c in t), sum(c in "#$%&*<>|{}=_/\\" for c in t),
            sum(c in "!?" for c in t), sum(c in ".,;:" for c in t)
        ]
        ws = [w for w in t.encode().split()]
        want = [
            np.log(n), np.log(len(ls)), np.log(max(len(ws), 1)), n / max(len(ws), 1) / 10, max(len(ws), 1) / len(ls) / 50,
            len(set(ws)) / max(len(ws), 1), 1 - len(set(ls)) / len(ls), not ws, *[k / n for k in kinds]
        ]
        assert np.allclose(row[: quality.LAYOUT], want, atol=1e-6)


def test_combined_quality_counts_the_prior_once():
    """Two views that know nothing give the labels' own share."""
    rows = quality.Rows.read(pa.RecordBatch.from_pydict({"text": ["same"] * 400}))
    y = np.random.default_rng(2).integers(0, 2, 400)
    model = quality.co_train(rows, y, (100, 900), lambda *_: [])
    assert all(abs(s - 0.9) < 0.01 for s in [x[0] for x in model.scores(rows)])


def test_toxicity_held_out(spark, tmp_path):
    got = op4_toxicity(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.score >= 0.5) == got.predicted).all()
    assert (got.predicted == got.toxic).mean() > 0.93
    n = odd_tables(spark, tmp_path)
    got = op4_toxicity(spark, str(tmp_path)).toPandas()
    assert len(got) == n and got.score.between(0, 1).all()


def test_toxicity_pooling_matches_direct_convolution():
    r = np.random.default_rng(2)
    texts = ["a b c d", "", None, "b", "c a c a b " * 20]
    w = tx.words(pa.array(texts))
    net = toxicity.Network.fresh(langid.Model([], np.zeros((0, 0))), 3)
    vectors = np.concatenate([r.normal(size=(len(w.vocab), toxicity.DIM)), np.zeros((1, toxicity.DIM))])
    codes, offsets = toxicity.padded(w.codes, w.offsets)
    got = net.responses(vectors, codes, offsets)
    for i in range(len(texts)):
        own = [*w.codes[w.offsets[i] : w.offsets[i + 1]], -1, -1, -1]
        at = 0
        for weight, bias in zip(net.filters, net.bias):
            windows = [sum(vectors[own[p + k]] @ weight[k] for k in range(len(weight)) if p + k < len(own)) for p in range(len(own))]
            assert np.allclose(got[i, at : at + toxicity.FILTERS], np.maximum(np.max(windows, axis=0) + bias, 0))
            at += toxicity.FILTERS


def sample_of(texts, labels, language=None):
    w = tx.words(pa.array(texts))
    spell, spells, codes = toxicity.features(w.vocab), [], []
    for a, b in zip(w.offsets[:-1], w.offsets[1:]):
        distinct, back = np.unique(w.codes[a:b], return_inverse=True)
        spells.append(spell[distinct].astype("<i4").tobytes())
        codes.append(back.astype("<i4").tobytes())
    return toxicity.Sample.of(pa.table({"spell": pa.array(spells, pa.binary()), "codes": pa.array(codes, pa.binary()), "y": labels, "language": [0] * len(texts) if language is None else language}))


NOBODY = langid.Model([], np.zeros((0, 0)))


def test_toxicity_gradients_match_differences():
    r = np.random.default_rng(4)
    own = sample_of([" ".join(r.choice(list("abcdef"), 1 + k)) for k in range(8)] + [""], [k % 2 for k in range(9)])
    net = toxicity.Network.fresh(NOBODY, 5)
    net.embed[:] = r.normal(0, 0.5, net.embed.shape)
    net.bias = [r.normal(0, 0.3, b.shape) for b in net.bias]  # away from the kink at zero
    codes, offsets = toxicity.padded(own.codes, own.offsets)
    spelled = np.concatenate([own.spell, np.full((1, own.spell.shape[1]), -1)])
    of_filters, of_bias, of_out, of_out_bias, (cells, move) = toxicity.gradients(net, spelled, codes, offsets[:-1], np.diff(offsets), own.labels)

    def loss():
        z = net.logits(own.spell, own.codes, own.offsets)
        return float(np.mean(np.log1p(np.exp(z)) - own.labels * z))

    def slope(array, at, step=1e-6):
        array[at] += step
        up = loss()
        array[at] -= 2 * step
        down = loss()
        array[at] += step
        return (up - down) / (2 * step)

    pairs = [(net.filters[1], (1, 3, 2), of_filters[1][1, 3, 2]), (net.filters[2], (2, 0, 5), of_filters[2][2, 0, 5]), (net.bias[0], (4,), of_bias[0][4]), (net.out, (7,), of_out[7])]
    pairs += [(net.embed, (cells[k], d), move[k, d]) for k in range(0, len(cells), 5) for d in (0, 6)]
    for array, at, want in pairs:
        assert abs(slope(array, at) - want) < 1e-6
    before = loss()
    net.out_bias += 1e-6
    assert abs((loss() - before) / 1e-6 - of_out_bias) < 1e-5


def test_toxicity_convolution_tells_order_where_words_do_not():
    """Both classes have the same words; only which of two stands first differs."""
    r = random.Random(3)
    texts, labels = [], []
    for k in range(600):
        own = [r.choice(["one", "two", "three", "four"]) for _ in range(12)]
        pair = ["red", "blue"] if k % 2 else ["blue", "red"]
        at = r.randint(0, 12)
        texts.append(" ".join(own[:at] + pair + own[at:]))
        labels.append(k % 2)
    net = toxicity.fit(sample_of(texts[:400], labels[:400]), NOBODY)
    rest = sample_of(texts[400:], labels[400:])
    assert ((rest.logits(net) > 0) == rest.labels).mean() > 0.95
    net.filters[1:] = [np.zeros_like(f) for f in net.filters[1:]]
    assert ((rest.logits(net) > 0) == rest.labels).mean() < 0.7


def test_toxicity_thresholds_match_trying_all():
    r = np.random.default_rng(7)
    for _ in range(200):
        x, y = r.integers(0, 6, 9) / 2.0, r.integers(0, 2, 9)
        cost = lambda t: (y[x < t].sum() / max(y.sum(), 1)) + 2 * ((1 - y)[x >= t].sum() / max((1 - y).sum(), 1))
        assert cost(toxicity.threshold(x, y)) <= min(cost(t) for t in np.arange(-0.75, 4, 0.25)) + 1e-9
    own = sample_of(["a"] * 80, [k % 2 for k in range(80)], [0] * 40 + [1] * 40)
    net = toxicity.Network.fresh(langid.Model(["x", "y"], np.zeros((0, 2))))
    own.logits = lambda _: np.concatenate([own.labels[:40] + 0.0, own.labels[40:] + 5.0])
    toxicity.calibrate(net, own)
    assert net.shift[:2].tolist() == [0.5, 5.5]


def test_toxicity_thresholds_of_many_rows_match_those_at_hand(spark):
    """Dealt out over parts, with equal logits, several best gaps and a language of one row."""
    r = np.random.default_rng(11)
    for size, grid in ((300, 8), (300, 200), (40, 3)):
        language, y = r.integers(0, 3, size), r.integers(0, 2, size)
        x = np.round(y + r.normal(0, 1.0, size) + language, 9) if grid == 200 else r.integers(0, grid, size) / 2.0
        language[0], language[1:] = 3, np.minimum(language[1:], 2)
        rows = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(language, x, y)], "language int, logit double, y int")
        got = toxicity.thresholds(rows)
        for k in (None, 0, 1, 2):
            at = np.full(size, True) if k is None else language == k
            assert got[k][:2] == (y[at].sum(), (1 - y[at]).sum()) and got[k][2] == pytest.approx(toxicity.threshold(x[at], y[at]))
    assert toxicity.thresholds(rows.where("y > 5")) == {}


def test_toxicity_thresholds_come_from_all_rows_held_back(spark):
    """However few rows are learned from: with 30 of each class learned, all of 1,000 rows held back set the threshold."""
    r = random.Random(4)
    docs = [(k, " ".join(r.choice("one two three four five six".split()) for _ in range(8)) + (" bad" if k % 3 == 0 and r.random() < 0.8 else ""), "en") for k in range(4000)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(4000)], "doc_id bigint, toxic int")
    net = toxicity.train(docs, labels, rows_per_class=30)
    known = labels.withColumnRenamed("toxic", "_y").where(toxicity.held_back(F.col("doc_id")))
    held = toxicity.sample(docs, known, net.languages)
    want = toxicity.threshold(held.logits(net), held.labels)
    assert 900 < len(held.labels) < 1100 and net.shift[0] == pytest.approx(want, abs=1e-9)


def by_hand(docs, text):
    """Language and shares of a text: counts of n-grams of lower-cased words, expectation-maximisation over its words for
    each set of the languages with the largest shares, the set by penalised likelihood."""

    def grams(word):
        raw = b" " + word.encode() + b" "
        for n in langid.ORDERS:
            for i in range(len(raw) - n + 1):
                h = n
                for c in raw[i : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                yield (h * 0x9E3779B1 & 0xFFFFFFFF) >> 17

    def lettered(t):
        return [w.decode() for w in t.lower().encode().split() if any(c.isalpha() for c in w.decode())]

    names = sorted({lang for _, lang in docs if lang})
    counts = {n: Counter(g for t, lang in docs if lang == n and t for w in lettered(t) for g in grams(w)) for n in names}
    total = {n: sum(counts[n].values()) + langid.SMOOTH * langid.BUCKETS for n in names}
    ws = lettered(text)
    logs = np.array([[langid.TEMPER * sum(np.log((counts[n][g] + langid.SMOOTH) / total[n]) for g in grams(w)) for n in names] for w in ws])
    p = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60))

    def em(allowed):
        share = np.array([1.0 / len(allowed) if k in allowed else 0.0 for k in range(len(names))])
        for _ in range(langid.ROUNDS):
            part = p * share
            share = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        return share, np.log((p * share).sum(axis=1)).sum()

    alone = np.log(p).sum(axis=0)
    best, value = np.eye(len(names))[alone.argmax()], alone.max()
    order = sorted(range(len(names)), key=lambda k: -em(range(len(names)))[0][k])
    cost = langid.PENALTY * 0.5 * np.log(max(len(ws), 2))
    for size in range(2, len(names) + 1):
        share, fit = em(order[:size])
        if fit - (size - 1) * cost > value:
            best, value = share, fit - (size - 1) * cost
    return {n: s for n, s in zip(names, best) if s > 0}


def test_languages_match_brute_force(spark):
    words = {"de": "der die und nicht über straße".split(), "en": "the of and with street over".split(), "fr": "les et dans rue été avec".split()}
    r = random.Random(5)
    say = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    docs = [(say(lang, 30), lang) for lang in words for _ in range(4)] + [(None, "de"), ("the", None), ("", "fr")]
    texts = [say("de", 40) + " " + say("en", 25), say("fr", 9), say("en", 3) + " 12 " + say("fr", 60), "Zug", " ".join(say(lang, 20) for lang in words), "12 !!", None]
    model = langid.train(spark.createDataFrame(docs, "text string, lang string"))
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model, F.lit(True)).orderBy("doc_id").collect()
    for row, t in zip(got[:5], texts):
        want = by_hand(docs, t)
        assert row.lang_pred == max(want, key=want.get) and set(row.languages) == set(want)
        assert all(abs(want[n] - s) < 1e-9 for n, s in zip(row.languages, row.shares))
    assert [r.lang_pred for r in got[5:]] == ["und", "und"]


def test_no_mixture_exceeds_the_bound():
    r = np.random.default_rng(6)
    for _ in range(50):
        p = np.exp(-r.exponential(2, (12, 3)))
        _, _, bound = langid.mixture(p, np.array([0, 12]), np.ones((1, 3)), rounds=2)
        for share in r.dirichlet([0.5] * 3, 200):
            assert np.log(p @ share).sum() <= bound[0] + 1e-9


def test_languages_held_out(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = op6_langid(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    n = odd_tables(spark, tmp_path)
    rows = op6_langid(spark, str(tmp_path)).toPandas()
    assert len(rows) == n and rows.score.between(0, 1).all()
    odd = rows[rows.doc_id.isin([900001, 900002]) | rows.doc_id.isna()]
    assert set(odd.lang_pred) == {"und"} and len(odd) == 3


def test_mixture_finds_both_languages():
    likely = np.log(np.array([[0.9, 0.1, 0.05]] * 30 + [[0.05, 0.9, 0.1]] * 70 + [[0.9, 0.1, 0.05]] * 50))
    got = langid.shares(likely, np.array([0, 100, 150, 150]))
    assert got[0, 2] == 0 and abs(got[0, 1] - 0.7) < 0.08
    assert got[1].tolist() == [1, 0, 0]


def test_word_grams_do_not_cross_words():
    buckets, offsets = langid.grams(pa.array(["ab", "é", "ab"]))
    assert np.diff(offsets).tolist() == [3 + 2 + 1, 3 + 2 + 1, 3 + 2 + 1]
    assert (buckets[offsets[0] : offsets[1]] == buckets[offsets[2] : offsets[3]]).all()
    alone, _ = langid.grams(pa.array(["ab"]))
    assert (alone == buckets[: offsets[1]]).all()


@pytest.mark.parametrize("query", [op1_quality, op4_toxicity, op6_langid])
def test_empty_tables(spark, tmp_path, query):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert query(spark, str(tmp_path)).count() == 0
