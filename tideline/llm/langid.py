"""Languages of a text as a mixture: each word comes from one language with probability given by its n-grams, and the
shares of the languages are estimated by expectation-maximisation. Which languages take part is chosen by the likelihood
less a penalty for each further language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import text as tx

BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
SMOOTH = 0.5
#: Overlapping n-grams tell the same thing more than once; their log-likelihoods count this much.
TEMPER = 0.4
ROUNDS = 8
#: A further language costs this many times half the logarithm of the number of words.
PENALTY = 2.0
UNKNOWN = "und"


def grams(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte n-grams of the words, each between blanks, and where each word's begin."""
    joined = np.frombuffer(b" " + b" ".join(vocab.cast(pa.binary()).to_pylist()) + b" ", np.uint8).astype(np.uint32)
    blank = np.flatnonzero(joined == 32)
    word = np.repeat(np.arange(len(blank) - 1), np.diff(blank))  # of each byte but the last; a blank goes with the word after it
    found, owner = [], []
    for n in ORDERS:
        if len(joined) < n:
            continue
        h = np.full(len(joined) - n + 1, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ joined[k : len(joined) - n + 1 + k]
        first = np.arange(len(h))
        own = word[np.minimum(first, len(word) - 1)] if len(word) else first
        ok = first + n - 1 <= blank[own + 1] if len(word) else np.zeros(0, bool)
        found.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(17))[ok].astype(np.int64))
        owner.append(own[ok])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(vocab) + 1, np.int64)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(vocab) + 1))


def lettered(vocab: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(vocab, r"\p{L}").to_numpy(zero_copy_only=False)


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


@dataclass
class Model:
    """table: log-likelihood of each n-gram bucket (rows) in each language (columns)."""

    names: list[str]
    table: np.ndarray

    def word_likelihoods(self, vocab: pa.Array) -> np.ndarray:
        buckets, offsets = grams(vocab)
        return TEMPER * tx.sums(self.table[buckets], offsets)

    def best(self, w: tx.Words) -> np.ndarray:
        """Per text the index of the one language that its words are likeliest in (the first of several); the number of
        languages for a text without letters, or where nothing was learnt."""
        texts = len(w.offsets) - 1
        if not self.names or not len(w.vocab):
            return np.full(texts, len(self.names))
        keep = lettered(w.vocab)
        likely = tx.sums((self.word_likelihoods(pc.utf8_lower(w.vocab)) * keep[:, None])[w.codes], w.offsets)
        return np.where(tx.sums(keep[w.codes], w.offsets) > 0, likely.argmax(axis=1), len(self.names))


def train(docs: DataFrame) -> Model:
    """n-gram likelihoods from all rows with a lang, counted in the tasks: the driver receives a number of counts bounded
    by languages times BUCKETS. Rows with null text or lang teach nothing; repeated rows count again."""
    known = docs.where("text is not null and lang is not null").select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in tx.pieces(whole):
                w = tx.words(lower(batch.column("text")), lower=False)
                if not len(w.vocab):
                    continue
                buckets, offsets = grams(w.vocab)
                keep = lettered(w.vocab)
                langs = batch.column("lang").to_numpy(zero_copy_only=False)
                of = langs[w.rows()]
                for lang in np.unique(langs.astype(str)):
                    n = np.bincount(w.codes[of == lang], minlength=len(w.vocab)) * keep
                    counts = np.bincount(buckets, np.repeat(n, np.diff(offsets)), BUCKETS)
                    total[lang] = total.get(lang, 0) + counts
        for lang, counts in total.items():
            b = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array(b), pa.array(counts[b])], names=["lang", "bucket", "c"])

    counted = known.mapInArrow(run, "lang string, bucket bigint, c double").groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toArrow()
    names = sorted(set(counted.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(names)))
    place = {x: i for i, x in enumerate(names)}
    counts[counted.column("bucket").to_numpy(), [place[x] for x in counted.column("lang").to_pylist()]] = counted.column("c").to_numpy()
    return Model(names, np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * BUCKETS)))


def mixture(likely: np.ndarray, offsets: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the allowed languages of each text, their log-likelihood, and what no shares can exceed: likely has a row
    for each word. The bound holds after any number of rounds: the log-likelihood is concave in the shares, and n words
    gain at most n log(max of the languages' mean likelihood ratios) over shares that are not the best yet."""
    n = np.diff(offsets)
    rows = np.repeat(np.arange(len(n)), n)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = likely * share[rows]
        part /= part.sum(axis=1, keepdims=True)
        share = tx.sums(part, offsets) / np.maximum(n, 1)[:, None]
        share = np.where(n[:, None] > 0, share, allowed / allowed.sum(axis=1, keepdims=True))
    with np.errstate(divide="ignore"):
        mixed = (likely * share[rows]).sum(axis=1)
        fit = tx.sums(np.log(mixed), offsets)
        ratio = tx.sums(likely * allowed[rows] / mixed[:, None], offsets) / np.maximum(n, 1)[:, None]
        return share, fit, fit + n * np.log(np.maximum(ratio.max(axis=1), 1.0))


def shares(log_likely: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Shares of the chosen languages; zero for the others.

    Candidate sets hold the 1, 2, ... languages with the largest shares when all take part. A text for which no mixture
    can gain more over its best single language than a second one costs (the bound of `mixture`) is settled at once."""
    likely = np.exp(np.maximum(log_likely - log_likely.max(axis=1, keepdims=True), -60))
    n = np.diff(offsets)
    cost = penalty * 0.5 * np.log(np.maximum(n, 2))
    alone = tx.sums(np.log(likely), offsets)
    single, best_of_one = alone.argmax(axis=1), alone.max(axis=1)
    out = np.eye(likely.shape[1])[single]
    if likely.shape[1] == 1:
        return out
    full, _, bound = mixture(likely, offsets, np.ones((len(n), likely.shape[1])))
    open_ = np.flatnonzero(bound - best_of_one > cost)
    if not len(open_):
        return out
    at = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in open_])
    own, own_offsets = likely[at], np.concatenate([[0], np.cumsum(n[open_])])
    rank = (-full[open_]).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    value, chosen = best_of_one[open_], out[open_]
    for size in range(2, likely.shape[1] + 1):
        share, fit, _ = mixture(own, own_offsets, (rank < size).astype(float))
        better = fit - (size - 1) * cost[open_] > value
        value = np.where(better, fit - (size - 1) * cost[open_], value)
        chosen[better] = share[better]
    out[open_] = chosen
    return out


def identify(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (the predicted language's share), languages and shares
    of all that take part, largest first. `und` with score 0 and no languages where the text is null or has no letter,
    or nothing was learnt. Ties go to the language that comes first by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                w = tx.words(lower(batch.column("text")), lower=False)
                pred, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
                langs: list[list[str]] = [[] for _ in pred]
                parts: list[list[float]] = [[] for _ in pred]
                if model.names and len(w.vocab):
                    keep = lettered(w.vocab)[w.codes]
                    offsets = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
                    found = shares(model.word_likelihoods(w.vocab)[w.codes[keep]], offsets)
                    for i in np.flatnonzero(np.diff(offsets)).tolist():
                        order = [k for k in (-found[i]).argsort(kind="stable").tolist() if found[i, k] > 0]
                        langs[i], parts[i] = [model.names[k] for k in order], found[i, order].tolist()
                        pred[i], score[i] = langs[i][0], min(1.0, parts[i][0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(pred), pa.array(score), pa.array(langs, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))],
                    names=["doc_id", "held_out", "lang_pred", "score", "languages", "shares"],
                )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>")
