import hashlib
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from tideline.llm import bpe, chat
from tideline.llm.queries import BYTE_RANKS, PATTERN, PROBE, WORD_BPE

ODD = ["", None, " \n\t ", "<|endoftext|>a<|startoftext|> b", "ΑΣ Σ'S don't", "e\u0301 \x1c x\x85y", "👍🏽 中文 ก็", "a" * 5000, "x " * 3000, "ﬁ ẞ İ 0123"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def test_ids_match_library_on_random_strings(library):
    r = random.Random(3)
    encoder = bpe.Encoder(WORD_BPE)
    for letters in ("ab", "etaoinshr", "abcdeéèñ'ΣΆ \t\x1c\x850!?.中ก็🏽\u0301각"):
        for _ in range(1500):
            s = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
            want = library.encode(s, add_special_tokens=False)
            got = encoder.encode(s)
            assert got.tolist() == want.ids, s
            assert encoder.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_ids_match_library_for_every_kind_of_character(library):
    """Every code point of the first four planes and the variation selectors, and every 16th of the empty planes, between
    two letters; then pairs of combining marks after a letter."""
    encoder = bpe.Encoder(WORD_BPE)
    points = [c for c in [*range(0x32000), *range(0xE0000, 0xE0200), *range(0x32000, 0x110000, 16)] if not 0xD800 <= c <= 0xDFFF]
    marks = [chr(c) for c in points if unicodedata.category(chr(c))[0] == "M"]
    texts = [f"a{chr(c)}b" for c in points] + [f"e{x}{y}" for i, x in enumerate(marks) for y in marks[i % 97 :: 97]]
    for a in range(0, len(texts), 20_000):
        some = texts[a : a + 20_000]
        for t, want in zip(some, library.encode_batch(some, add_special_tokens=False)):
            assert encoder.encode(t).tolist() == want.ids, t.encode("unicode_escape")


def test_runs_met_again_after_the_cache_is_full(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORD_CACHE", 3)
    encoder = bpe.Encoder(WORD_BPE)
    for t in ["one two three four five", "five one one six", "two seven"] * 3:
        assert encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(encoder.known) <= 3 and len(encoder.earlier) <= 3


def test_documents_keep_their_columns_and_repeated_rows(spark, library):
    rows = [(i, t, "x", 5) for i, t in enumerate(ODD)] + [(None, "again", None, 1), (3, ODD[3], "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_tokens int").repartition(3)
    got = bpe.decode(bpe.encode(docs, WORD_BPE), WORD_BPE).collect()
    assert len(got) == len(rows)
    for row in got:
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.token_ids == want and row.n_tokens == len(want)
        assert row.decoded == library.decode(want, skip_special_tokens=False)
    for row in bpe.digest(docs, WORD_BPE).collect():
        want = next(g for g in got if g.doc_id == row.doc_id)
        assert row.ids_sha256 == hashlib.sha256(np.array(want.token_ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(want.decoded.encode()).hexdigest()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.digest(empty, WORD_BPE).count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digest(chat.assemble(turns, BYTE_RANKS, PATTERN), BYTE_RANKS, PATTERN).count() == 0


def test_escape_is_reversible():
    r = random.Random(4)
    for _ in range(3000):
        s = "".join(r.choice(["\\", "#", "###", "</turn>", ": ", ":", " ", "a", "\n"]) for _ in range(r.randint(0, 12)))
        assert chat.unescape(chat.escape(s)) == s
        for mark in ("###", "</turn>"):
            at = chat.escape(s).find(mark)
            assert at <= 0 and not chat.escape(s).startswith(mark) or chat.escape(s)[at - 1] == "\\"


def test_chat_reads_back(spark):
    rows = [
        (1, 1, "assistant", "second </turn>\n### user: x"), (1, 0, "user", PROBE), (1, 2, "assistant", None), (1, 2, "assistant", "é👍"),
        (None, 0, None, "no id"), (2, None, "assistant", ""), (3, 5, "sys: tem", "a" * 30000), (3, 5, "sys: tem", "a" * 30000),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    segments = chat.assemble(turns, BYTE_RANKS, PATTERN)
    got = {r.conv_id: r for r in chat.digest(segments, BYTE_RANKS, PATTERN).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] is not None, x[3] or ""))
        lost = "".join(x[3] or "" for x in own if x[2] == "assistant")
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        assert (r.n_turns, r.loss_chars) == (len(own), len(lost))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(lost.encode()).hexdigest()
    text = {(r.conv_id, r.turn): r.written for r in chat.written(segments, BYTE_RANKS, PATTERN).collect() if r.conv_id == 1}
    assert text[1, 0] == "### user: \\\\\\### Assistant\\: \\</turn> ok</turn>\n"
    assert got[1].formatted_chars == sum(len(r.written) for r in chat.written(segments, BYTE_RANKS, PATTERN).collect() if r.conv_id == 1)


def test_words_of_one_spelling_are_merged_once(library, monkeypatch):
    """Runs that differ in case or signs only share the work, within a batch and after it; odd runs do not disturb others."""
    walked = []
    real = bpe.Encoder.encode_words
    monkeypatch.setattr(bpe.Encoder, "encode_words", lambda self, words: (walked.extend(words), real(self, words))[1])
    encoder = bpe.Encoder(WORD_BPE)
    runs = ["Zorquill,", "zorquill", "ZORQUILL.", "élan?", "", "ab", "<|endoftext|>x<|endoftext|>", "don't", "x\x85y", "\x85", "zorquill"]
    for _ in range(2):
        for run, got in zip(runs, encoder.encode_runs(runs)):
            assert np.frombuffer(got, np.uint32).tolist() == library.encode(run, add_special_tokens=False).ids, run
    assert walked.count("zorquill") == 1


class Captured:
    """Takes the place of documents, to get hold of the function that a task runs."""

    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])

    def drop(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_a_batch_is_taken_in_small_parts(library):
    """What a task unpacks of a batch at a time holds under 1 MB of text, or one document: its memory stays small."""
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("aeiourstln") for _ in range(r.randint(4, 9))) for _ in range(6000)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(bpe.encode(Captured(), WORD_BPE)(iter([batch])))
    assert sum(p.num_rows for p in parts) == 40
    assert max(sum(map(len, p.column("text").to_pylist())) for p in parts) < 1 << 20
    got = [ids for p in parts for ids in p.column("token_ids").to_pylist()]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
