"""BPE encoding and decoding with a word-level merge table.

Every prefix of a word has exactly one token that can end its encoding. `Encoder` finds it left to right: an automaton
with suffix links over all tokens names the tokens that end at a position, and a token is taken if it may follow the
stored last token of the prefix before it. Following the stored tokens back from the end gives the ids. Whether two
tokens may stand side by side depends on the merge table alone and is kept for later words. Many words are gone through as
one string, which no token crosses.

Normal forms, lower case and the split into words are taken from the tokenizer file by the library that defines them, so
that both know the same version of Unicode; merging is done here. Runs of ASCII letters, alone or before one sign, need no
library if the file is found to leave them whole but for their case.
"""

from __future__ import annotations

import hashlib
import json
import string
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tideline.llm import text as tx
from tideline.llm.spark_io import tidied

#: What stands after a word in place of its end mark, and between words; the byte characters of a word are neither.
END, BETWEEN = " ", "\n"
#: A character that stands between runs for the library, as a piece of its own.
MARK = "\ue000"
MAX_WORD_CACHE, MAX_PAIR_CACHE = 80_000, 200_000
#: Characters of words that are gone through at once, and runs that the library splits at once.
WALK, SPLIT = 1 << 16, 256


class Encoder:
    """Encoder for a tokenizer file with byte-level pieces and `</w>` word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = model["vocab"] | self.special
        self.names = [""] * (max(ids.values()) + 1)
        for t, i in ids.items():
            self.names[i] = t
        # the file's normaliser and splitter without its vocabulary
        steps = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.normal, self.split = steps.normalizer, steps.pre_tokenizer
        letters = string.ascii_letters
        self.plain = self.pieces(letters) == [letters.lower()]
        self.tails = {x for x in string.punctuation if self.plain and self.pieces(letters + x) == [letters.lower(), x]}
        self.mark = self.pieces(MARK)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.matches, self.length = ahocorasick.Automaton(), np.zeros(len(self.names), np.int32)
        for t, i in model["vocab"].items():
            inner = t[: -len(suffix)] + END if t.endswith(suffix) and len(t) > len(suffix) else t
            self.matches.add_word(inner, (i, len(inner)))
            self.length[i] = len(inner)
        self.matches.make_automaton()
        # rank of each merge (of a << 20 | b), and of each token the rank that makes it and its halves
        self.rank: dict[int, int] = {}
        self.made, self.left, self.right = ([-1] * len(self.names) for _ in range(3))
        vocab = model["vocab"]
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 20 | vocab[b]] = r
            token = vocab[a + b]
            self.made[token], self.left[token], self.right[token] = r, vocab[a], vocab[b]
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def pieces(self, part: str) -> list[str]:
        return [x for x, _ in self.split.pre_tokenize_str(self.normal.normalize_str(part))]

    def crossed(self, a: int, b: int, below: float = float("inf")) -> bool:
        """Whether a merge of a rank under `below` comes up across the seam of a and b while both of its sides are there.
        Of two equal merges the left one goes first.

        The pieces at the seam are gone through from the last ones back, what was made last being taken apart first: so
        exactly those are met that are there at the same time."""
        made, x_used, y_used = self.made, below, below
        x_made, y_made = made[a], made[b]
        while True:
            r = self.rank.get(a << 20 | b)
            if r is not None and x_made < r < x_used and y_made < r <= y_used and r < below:
                return True
            if x_made < 0 and y_made < 0:
                return False
            if x_made >= y_made:
                x_used, a = x_made, self.right[a]
                x_made = made[a]
            else:
                y_used, b = y_made, self.left[b]
                y_made = made[b]

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their symbols are merged together."""
        key = a << 20 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= MAX_PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[key] = not self.crossed(a, b)
        return known

    def whole(self, token: int) -> bool:
        """Whether a token is what its own symbols merge to."""
        key = -1 - token
        if (known := self.pairs.get(key)) is None:
            a, b, r = self.left[token], self.right[token], self.made[token]
            known = r < 0 or self.whole(a) and self.whole(b) and not self.crossed(a, b, r)
            self.pairs[key] = known
        return known

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, given as byte characters, one after another, and how many each has."""
        flat, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(words):
            stop, left = at, WALK
            while stop < len(words) and (left > 0 or stop == at):
                left -= len(words[stop])
                stop += 1
            ids, n = self._walk(words[at:stop])
            flat.append(ids)
            counts.append(n)
            at = stop
        return np.concatenate(flat), np.concatenate(counts)

    def _walk(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = BETWEEN + (END + BETWEEN).join(words) + END
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes + 2) - 1
        # of each place the token that ends there, moved up; -1: none yet, -2: before a word
        last, pairs = [-1] * len(text), self.pairs
        for i in (ends - sizes - 1).tolist():
            last[i] = -2
        for end, (token, length) in self.matches.iter(text):
            if last[end] != -1:
                continue
            before = last[end - length]
            if before == -1:
                continue
            try:
                fit = pairs[before | token if before >= 0 else -1 - token]
            except KeyError:
                fit = self.fits(before >> 20, token) if before >= 0 else self.whole(token)
            if fit:
                last[end] = token << 20
        stored = np.array(last, np.int64) >> 20
        stored[ends - sizes - 1] = -2
        at, live, back = ends, np.arange(len(words)), []
        n = np.zeros(len(words), np.int64)
        while len(live):
            token = stored[at]
            if (token < 0).any():
                raise ValueError("a word has symbols that the tokenizer file lacks")
            back.append((live, token))
            n[live] += 1
            at = at - self.length[token]
            more = stored[at] != -2
            at, live = at[more], live[more]
        flat, stops = np.zeros(n.sum(), np.uint32), np.cumsum(n)
        for k, (live, token) in enumerate(back):
            flat[stops[live] - 1 - k] = token
        return flat, n

    def encode_runs(self, runs: list[str], times: np.ndarray | None = None) -> list[bytes]:
        """Ids of runs without ASCII white space, 32 bits each; times: how often each run occurs. Words that occur once and
        were not met before are not kept: few of them come again."""
        split, count = self._split(runs), {}
        ids = {END + str(i): i.to_bytes(4, "little") for i in self.special.values()}
        for own, c in zip(split, times.tolist() if times is not None else [2] * len(split)):
            for x in own:
                count[x] = count.get(x, 0) + c
        new = []
        for x in count:
            if x in ids:
                continue
            if (found := self.known.get(x)) is None:
                found = self.earlier.get(x)
                if found is None:
                    new.append(x)
                    continue
                self._keep(x, found)
            ids[x] = found
        flat, n = self.encode_words(new)
        raw, at = flat.tobytes(), 0
        for x, m in zip(new, n.tolist()):
            ids[x] = raw[at : at + 4 * m]
            at += 4 * m
            if count[x] > 1:
                self._keep(x, ids[x])
        return [ids[own[0]] if len(own) == 1 else b"".join([ids[x] for x in own]) for own in split]

    def _keep(self, word: str, ids: bytes) -> None:
        if len(self.known) >= MAX_WORD_CACHE:
            self.known, self.earlier = {}, self.known  # words that are met again move over
        self.known[word] = ids

    def _split(self, runs: list[str]) -> list[list[str]]:
        """The words of each run as byte characters, in order; a special token between them comes as its id after END."""

        def plain(x: str) -> list[str]:
            if self.plain and x.isascii():
                if x.isalpha():
                    return [x.lower()]
                if x[-1] in self.tails and x[:-1].isalpha():
                    return [x[:-1].lower(), x[-1]]
            return []

        out = [plain(x) for x in runs]
        odd = [k for k, words in enumerate(out) if not words]
        for a in range(0, len(odd), SPLIT):
            some = odd[a : a + SPLIT]
            text = f" {MARK} ".join([runs[k] for k in some])
            if text.count(MARK) >= len(some) or self.cut and self.cut.search(text):
                for k in some:
                    for n, part in enumerate(self.cut.split(runs[k]) if self.cut else [runs[k]]):
                        out[k] += [END + str(self.special[part])] if n % 2 else self.pieces(part)
                continue
            own = iter(some)
            words = out[next(own)]
            for x in self.pieces(text):
                if x == self.mark[0]:
                    words = out[next(own)]
                else:
                    words.append(x)
        return out

    def forget(self) -> None:
        """Gives back the memory of words and pairs at the end of a task: other work follows in the same process."""
        self.known, self.earlier, self.pairs = {}, {}, {}

    def encode(self, content: str | None) -> np.ndarray:
        runs = [x.decode("utf-8") for x in (content or "").encode("utf-8").split()]
        own = list(dict.fromkeys(runs))
        ids = dict(zip(own, self.encode_runs(own)))
        return np.frombuffer(b"".join([ids[x] for x in runs]), np.uint32)

    def decode(self, ids) -> str:
        """The tokens' texts joined by blanks, special tokens included: such files name no decoder."""
        return " ".join([self.names[int(i)] for i in ids])

    def spelled(self, runs: list[bytes]) -> list[str]:
        """The decoded text of each run of ids."""
        names = [self.names[i] for i in np.frombuffer(b"".join(runs), np.uint32).tolist()]
        ends = np.cumsum([len(x) // 4 for x in runs]).tolist()
        return [" ".join(names[a:b]) for a, b in zip([0, *ends], ends)]


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker process; its tables stay from one task to the next, its words do not (`forget`)."""
    return Encoder(path)


def concat(parts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of parts[c] for each c in codes, one after another, and how many each has."""
    flat = np.frombuffer(b"".join(parts), np.uint32)
    size = np.array([len(p) // 4 for p in parts], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])[:-1] if len(size) else size
    n = size[codes]
    at = np.repeat(start[codes] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum()) if len(codes) else np.zeros(0, np.int64)
    return flat[at], n


def encode(docs: DataFrame, path: str, column: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """docs with `token_ids` (ids=True), `n_tokens`, and with digests=True `ids_sha256` and `decoded_sha256`; columns of
    these names in docs are replaced. A null or empty text has no tokens. Rows stay where they are: nothing is shuffled,
    and each task keeps at most twice MAX_WORD_CACHE words and a few MB of text."""
    new = [*(["token_ids array<int>"] * ids), "n_tokens bigint", *(["ids_sha256 string", "decoded_sha256 string"] * digests)]
    docs = docs.drop(*[x.split()[0] for x in new])
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for whole in batches:
            for batch in tx.pieces(whole, column, tx.PIECE_BYTES // (8 if ids else 1)):
                w = tx.words(batch.column(column), lower=False)
                found = encoder.encode_runs(w.vocab.to_pylist(), np.bincount(w.codes, minlength=len(w.vocab)))
                flat, n = concat(found, w.codes)
                ends = np.concatenate([[0], np.cumsum(n)])[w.offsets]
                out = [pa.array(np.diff(ends))]
                if ids:
                    out.insert(0, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32))))
                if digests:
                    raw, spelled = flat.astype("<u4").tobytes(), encoder.spelled(found)
                    out.append(pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]))
                    said = []
                    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist()):
                        said.append(hashlib.sha256(" ".join([x for c in w.codes[a:b].tolist() if (x := spelled[c])]).encode("utf-8")).hexdigest())
                    out.append(pa.array(said, pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *[x.split()[0] for x in new]])
        encoder.forget()

    return docs.mapInArrow(tidied(run), fields)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with `decoded`, the text that its token_ids stand for; null ids give null."""
    encoded = encoded.drop("decoded")
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields] + ["decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(tidied(run), fields)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The digest columns of `encode`, one row per document."""
    return encode(docs.select("doc_id", "text"), path, ids=False, digests=True).drop("text")


__all__ = ["Encoder", "decode", "digest", "encode"]
