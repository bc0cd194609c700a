"""Token numbers against those of the libraries, for pieces of any size."""

import random

import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tideline.llm import queries, tokencount

SF = "/root/testdata/sf0.001"
EDGES = [
    None, "", " ", "  ", "   a", "a ", "a  ", "a\n b", "\n", "\t\t", "<s>x</s> <unk> <0x41>", "▁", "▁▁a ▁b", "a▁ ▁", "1234567", "a" * 300, " " * 100, "日本語テキスト", "ａ①ﬁ", "\U0001f600" * 40,
    "é é", "\0", "x y\u0085z", "�", "The quick brown fox. " * 40, "a b" * 50,
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def noise(seed: int, size: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(" \n▁aeinrstxyz  theing,.01éß日\U0001f600<s>") for _ in range(size))


@pytest.mark.parametrize("size", [1, 2, 5, 17, 1 << 15])
def test_pieces_of_any_size_count_as_the_whole(model, size):
    counter = tokencount.Pieces(queries.PIECES)
    texts = EDGES + [noise(k, 200) for k in range(60)]
    assert counter.splits
    got = tokencount.count_texts(pa.array(texts), counter, size, limit=64).tolist()
    assert got == [len(model.encode(t or "")) for t in texts]
    for t in texts[1:]:
        assert "".join(counter.cut(t, size)) == t


def test_long_texts_are_cut_and_batches_bounded(model):
    counter = tokencount.Pieces(queries.PIECES)
    long = noise(7, 60_000)
    assert len(list(counter.cut(long, 1000))) > 50
    batches = list(tokencount.balanced(iter([long, "b", None, long]), counter.cut, 1000, 4000))
    assert max(sum(len(p.encode()) for _, _, p in b) for b in batches) <= 4000 and len(batches) > 30
    assert tokencount.count_texts(pa.array([long]), counter, 1000).tolist() == [len(model.encode(long))]


def test_tokenizers_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)] + [(99, "<|endoftext|> a")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.count(docs, path).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in [*enumerate(EDGES), (99, "<|endoftext|> a")]}


def test_columns_of_the_same_names_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, None, 5, "x"), (1, None, 5, "x"), (None, "a b", 6, None)], "doc_id long, text string, n_tokens int, over_limit string")
    out = tokencount.count(docs, queries.PIECES, limit=1)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, out.drop("text").collect()), key=str) == [(1, 0, 0, False), (1, 0, 0, False), (None, 3, 2, True)]
    assert tokencount.count(docs.where("doc_id = 0"), queries.PIECES).count() == 0


def test_query_equals_the_library(spark, model):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.queries()["op11_tokencount"](spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()}
    want = {k: len(model.encode(t)) for k, t in texts.items()}
    assert got == {k: (len(t.encode()), want[k], want[k] > 4096) for k, t in texts.items()}
