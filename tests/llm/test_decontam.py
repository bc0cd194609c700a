import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tideline.llm import decontam


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def grams(ws, k):
    return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))


def brute(docs, items):
    """Per document and item: the best similarity of any window, and the first of the best aligned windows."""
    out = {}
    for item, text in {(i, t) for i, t in items if i is not None}:
        own = words(text)
        if not own:
            continue
        n, k = len(own), min(5, len(own))
        want = grams(own, k)
        places = {}
        for j in range(n - k + 1):
            places.setdefault(tuple(own[j : j + k]), []).append(j)
        for d, t, *_ in docs:
            ws = words(t)
            if len(ws) < k:
                continue
            last = max(len(ws) - n, 0)
            alike = lambda s: sum((w & want).values()) / sum((w | want).values()) if (w := grams(ws[s : s + n], k)) else 0
            best = max(alike(s) for s in range(last + 1))
            aligned = sorted({min(max(i - j, 0), last) for i in range(len(ws) - k + 1) for j in places.get(tuple(ws[i : i + k]), [])})
            if best >= 0.8:
                start = max(aligned, key=alike)
                out[d, item] = max(out.get((d, item), (0, 0)), (round(best, 9), -start))
    return out


def fixture():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([15, 20, 38, 60, 90, 5, 3, 1])]
    docs = []
    for i in range(60):
        body = [word() for _ in range(r.randint(0, 120))]
        if i % 3:
            copy = r.choice(items[:7])[1].split()
            if i % 3 == 2 and len(copy) > 30:
                copy[r.randrange(len(copy))] = "edit"
                if i % 2:
                    copy.insert(r.randrange(len(copy)), "more")
            at = r.randint(0, len(body))
            body[at:at] = [w.upper() + ("," if r.random() < 0.2 else "") for w in copy]
        docs.append((i * 3, " ".join(body), "x", 1))
    docs += [docs[1], docs[1], (500, None, "x", 1), (501, "", "x", 1), (None, items[2][1], "x", 1), (502, "é " * 30000 + items[3][1], None, 1), (503, items[2][1] + " " + items[2][1], "x", 0)]
    items += [(3, items[3][1]), (90, None), (91, ""), (None, "no id at all here please")]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = fixture()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, hash string, n int").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.matches(df, bench).collect()
    want = brute(docs, items)
    assert len(got) == len({(g.doc_id, g.item_id) for g in got})
    assert {(g.doc_id, g.item_id): (round(g.similarity, 9), -g.start) for g in got} == want
    assert 0 < sum(g.similarity < 1 for g in got)
    kept = decontam.clean(df, bench)
    assert kept.columns == ["doc_id", "text", "hash", "n"]
    hit = {d for d, _ in want}
    assert sorted(str(k.doc_id) for k in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] not in hit)


def test_index_holds_every_fingerprint_within_the_radius(spark):
    r = random.Random(3)
    items = decontam.items_of(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id bigint, text string"))
    index = {(x.block, x.value) for x in decontam.multi_index(items).select("block", "value").collect()}
    fp = decontam.multi_index(items).first().item_fp & (2**64 - 1)
    for _ in range(500):
        other = fp ^ sum(1 << b for b in r.sample(range(64), r.randint(0, decontam.RADIUS)))
        assert any((b, other >> 16 * b & 0xFFFF) in index for b in range(4))


def test_simhash_bits(spark):
    r = random.Random(5)
    hs = [r.getrandbits(64) - (1 << 63) for _ in range(31)]
    got = spark.range(1).select(decontam.simhash(F.array(*[F.lit(h) for h in hs]))).first()[0] & (2**64 - 1)
    assert got == sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hs) > len(hs))


def test_recall_of_edited_copies(spark):
    """Of copies with a few words changed, put in, left out or moved, against the best of all windows: what is found, and
    that its similarity is the best one."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 60, 100])]
    docs = []
    for d in range(300):
        copy = items[d % 3][1].split()
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(copy))
            kind = r.randrange(4)
            if kind == 0:
                copy[at] = word()
            elif kind == 1:
                copy.insert(at, word())
            elif kind == 2:
                del copy[at]
            else:
                copy = copy[at:] + copy[:at] if at < 5 else copy
        docs.append((d, " ".join([word() for _ in range(r.randint(0, 30))] + copy + [word() for _ in range(r.randint(0, 30))])))
    want = brute(docs, items)
    found = decontam.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(g.doc_id, g.item_id): round(g.similarity, 9) for g in found}
    assert len(want) > 100 and set(got) <= set(want)
    assert len(got) >= 0.99 * len(want)
    assert sum(got[k] == want[k][0] for k in got) >= 0.99 * len(got)


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "some text of six whole words", 1, 2, 3, 4), (2, "other", 5, 6, 7, 8)], "doc_id bigint, text string, _d int, _t int, doc_key int, text_hash int")
    bench = spark.createDataFrame([(1, "some text of six whole words", 0)], "item_id bigint, text string, hash int")
    assert [tuple(x) for x in decontam.clean(docs, bench).collect()] == [(2, "other", 5, 6, 7, 8)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text of six whole words", 1)], "doc_id bigint, text string, n int")
    bench = spark.createDataFrame([(1, "some text of six whole words")], "item_id bigint, text string")
    assert decontam.matches(docs, bench.where("false")).count() == 0
    assert decontam.matches(docs.where("false"), bench).count() == 0
    assert decontam.clean(docs, bench.where("false")).count() == 1
    assert decontam.clean(docs, bench).count() == 0


def test_documents_shorter_than_an_item_are_compared_whole(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([60, 40, 12, 5, 3])]
    rows = [(10 * i + j, " ".join(ws[a : len(ws) - b]), t) for i, t in items for ws in [t.split()] for j, (a, b) in enumerate([(0, 0), (0, 1), (0, 3), (3, 0), (1, 1), (0, len(ws) // 2)])]

    def alike(text, item):
        k = min(5, len(item.split()))
        a, b = grams(text.split(), k), grams(item.split(), k)
        return sum((a & b).values()) / sum((a | b).values())

    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {d: round(alike(t, item), 9) for d, t, item in rows if alike(t, item) >= 0.8}
    assert 2 in want and 5 not in want
    assert {g.doc_id: round(g.similarity, 9) for g in decontam.matches(docs, bench).collect()} == want
    assert {k.doc_id for k in decontam.clean(docs, bench).collect()} == {d for d, *_ in rows} - set(want)


def spark_simhash(ws):
    hs = []
    for i in range(len(ws) - 4):
        h = 42
        for w in ws[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        hs.append(h)
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_similar_windows_of_distant_fingerprints_match(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(59)]
    docs, own, want = [], spark_simhash(item), grams(item, 5)
    while len(docs) < 12:
        ws = list(item)
        at = r.randrange(58)
        ws[at], ws[at + 1] = word(), word()
        got = grams(ws, 5)
        if sum((got & want).values()) / sum((got | want).values()) >= 0.8 and (spark_simhash(ws) ^ own).bit_count() > 15:
            docs.append((len(docs), " ".join(ws)))
    found = decontam.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert {g.doc_id for g in found.collect()} == set(range(12))
