"""Numbers of tokens of whole texts, without keeping a token.

Workers hold the tokenizer, cut long texts at boundaries that no token can cross, put the pieces of many texts together
into batches of about equal bytes, and give back lengths only. Texts stay in their partitions: nothing is shuffled.

Null and empty texts have no tokens. Bytes are those of UTF-8. Rows that repeat are counted each; columns of any other
name stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

#: Code points of a piece of a long text, and bytes of the pieces that one call of the library encodes.
PIECE, BATCH_BYTES = 1 << 15, 1 << 18
#: How a piece model writes a blank, and the code of pieces that a user defined (fixed values of the file format).
BLANK, USER_DEFINED = "▁", 4


class Pieces:
    """Counter for a sentencepiece model.

    Merging never joins what is not inside one piece of the vocabulary. Two characters that stand side by side in no piece
    therefore end up in different tokens wherever they meet, and the two sides of that seam are encoded as if alone.
    Later parts of a text go to a copy of the model that adds no blank in front."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        self.first = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        spec, kind = proto.normalizer_spec, proto.trainer_spec
        #: Only then do the sides of a seam not know of each other; else texts are encoded whole.
        self.splits = (
            kind.model_type == kind.BPE and kind.byte_fallback and not kind.treat_whitespace_as_suffix and spec.escape_whitespaces
            and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and all(p.type != USER_DEFINED for p in proto.pieces)
        )
        self.inside = {a + b for p in proto.pieces if p.type == p.NORMAL for a, b in zip(p.piece, p.piece[1:])}
        spec.add_dummy_prefix = False
        self.rest = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def seam(self, text: str, at: int, least: int) -> int:
        """The last safe boundary at or before `at` and after `least`, else the first one after `at`, else the end."""
        shown = text[least : at + 1].replace(" ", BLANK)
        for i in range(len(shown) - 1, 0, -1):
            if shown[i - 1 : i + 1] not in self.inside:
                return least + i
        for i in range(at + 1, len(text)):
            if text[i - 1 : i + 1].replace(" ", BLANK) not in self.inside:
                return i
        return len(text)

    def cut(self, text: str, size: int = PIECE) -> Iterator[str]:
        """Pieces of about `size` code points whose tokens together are the text's."""
        start = 0
        while self.splits and len(text) - start > size:
            end = self.seam(text, start + size, start)
            yield text[start:end]
            start = end
        if start < len(text) or not text:
            yield text[start:]

    def lengths(self, firsts: list[str], rests: list[str]) -> tuple[list[int], list[int]]:
        """Numbers of tokens of pieces that begin a text, and of others."""
        return [[len(ids) for ids in s.encode(x, num_threads=1)] if x else [] for s, x in ((self.first, firsts), (self.rest, rests))]


class Library:
    """Counter for a tokenizers file, whose texts are encoded whole. Strings of special tokens are read as the library does."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def cut(self, text: str, size: int = PIECE) -> Iterator[str]:
        yield text

    def lengths(self, firsts: list[str], rests: list[str]) -> tuple[list[int], list[int]]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(firsts, add_special_tokens=False)] if firsts else [], []


@lru_cache(2)
def counter_of(path: str) -> Pieces | Library:
    """The counter of a worker process."""
    return Pieces(path) if path.endswith(".model") else Library(path)


def balanced(texts: Iterator[str | None], cut: Callable, size: int, limit: int) -> Iterator[list[tuple[int, bool, str]]]:
    """(text's number, whether the piece begins it, piece) in batches of about `limit` bytes (one piece at least)."""
    held, total = [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        for n, piece in enumerate(cut(text, size)):
            weight = len(piece) if piece.isascii() else len(piece.encode("utf-8"))
            if held and total + weight > limit:
                yield held
                held, total = [], 0
            held.append((k, n == 0, piece))
            total += weight
    if held:
        yield held


def count_texts(texts: pa.Array, counter: Pieces | Library, size: int = PIECE, limit: int = BATCH_BYTES) -> np.ndarray:
    """Number of tokens of each text; zero for null and empty ones."""
    out = np.zeros(len(texts), np.int64)
    for batch in balanced((x.as_py() for x in texts), counter.cut, size, limit):
        first, rest = ([(k, piece) for k, begins, piece in batch if begins is which] for which in (True, False))
        for own, n in zip((first, rest), counter.lengths([p for _, p in first], [p for _, p in rest])):
            np.add.at(out, [k for k, _ in own], n)
    return out


def count(docs: DataFrame, path: str, column: str = "text", limit: int = 4096) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more than `limit` tokens); columns of these names are replaced. path: a
    piece model (.model) or a tokenizers file (.json), readable where tasks run. A text without any safe boundary is encoded
    as one piece however long it is."""

    @F.arrow_udf("bigint")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = counter_of(path)
        for texts in batches:
            yield pa.array(count_texts(texts, counter))

    new = ("n_bytes", "n_tokens", "over_limit")
    kept = docs.drop(*[c for c in new if c != column])
    made = kept.withColumns({"n_bytes": F.coalesce(F.octet_length(column), F.lit(0)).cast("bigint"), "n_tokens": tokens(F.col(column))})
    return made.withColumn("over_limit", F.col("n_tokens") > limit)


__all__ = ["Library", "Pieces", "count", "count_texts"]
