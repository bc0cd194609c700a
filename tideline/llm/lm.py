"""Scoring with a bigram model whose counts lie in a log-frequency Bloom filter.

The counts of all training words and bigrams are added up over the cluster and put, on a logarithmic scale, into one
filter that every worker gets. A token's probability mixes the bigram's relative frequency with the word's own; the
weight depends on how often the word before was seen and is fitted by leave-one-out over all training tokens.

A token's probability depends on three levels only: of the word before, of the word and of both together. One pass probes
the filter and leaves for every text how often each combination of levels (a cell) occurs. The cells of the training
texts give the weights, and each text's own cells give its score.

The filter grows with the corpus. Where its bigrams would take more than `max_bytes`, it holds those from the least count
on that fits (from a sample of bigrams by hash), and the rarer ones are looked up by a join: none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import bloom
from tideline.llm import text as tx
from tideline.llm.spark_io import cut, tidied

START, STOP = np.uint64(0x5354415254), np.uint64(0x53544F50)
UNIGRAM = np.uint64(0x554E4947)
#: Share of bigrams (by hash) that the least count is taken from.
SAMPLE_BITS = 10
MAX_BYTES = 112 << 20
BITS_PER_ENTRY = 7
#: Words whose exact counts every worker holds; the counts of all others are joined.
FREQUENT = 1 << 18
FLUSH = 2_000_000
#: Bytes of words that a task holds before it adds up their counts.
HELD_BYTES = 24 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Bytes of text whose bigrams a task takes at a time.
PIECE_BYTES = 1 << 20
#: Levels of a count: a cell's number is (level of the word before * CLASSES + level of the word) * CLASSES + level of both.
CLASSES = 64
#: Bits of a packed cell that hold its number; the rest hold how often it occurs, over several entries if need be.
CELL_BITS = 18


def word_hashes(vocab: pa.Array) -> np.ndarray:
    """64-bit hash of each word: its length, then its bytes, eight at a time (long words: XXH64 of the bytes)."""
    vocab = vocab.cast(pa.binary())
    _, offsets, data = vocab.buffers()
    ends = np.frombuffer(offsets, np.int32)[vocab.offset : vocab.offset + len(vocab) + 1].astype(np.int64)
    held = np.zeros(ends[-1] - ends[0] + 8, np.uint8)
    if data is not None:
        held[:-8] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    eights = np.ndarray(len(held) - 7, "<u8", held, strides=(1,))  # the eight bytes from each byte on
    at, left = ends[:-1] - ends[0], np.diff(ends)
    out, live = bloom.mix(left.astype(np.uint64)), np.flatnonzero((left > 0) & (left <= LONG_WORD))
    while len(live):
        some = left[live]
        cut_off = np.uint64(8) * np.maximum(8 - some, 0).astype(np.uint64)
        out[live] = bloom.mix(out[live] ^ (eights[at[live]] << cut_off))
        at[live] += 8
        left[live] -= 8
        live = live[some > 8]
    for k in np.flatnonzero(left > LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(vocab[k].as_py())
    return out


def token_hashes(w: tx.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token (each text's words and its end) its hash and that of the token before, and where texts begin. hashes:
    those of w's vocab."""
    n, docs = len(w.codes), len(w.offsets) - 1
    now = np.full(n + docs, STOP)
    if n:
        now[np.arange(n) + w.rows()] = hashes[w.codes]
    offsets = w.offsets + np.arange(docs + 1)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[offsets[:-1]] = START
    return now, before, offsets


def pair_keys(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return bloom.mix(bloom.mix(before) * np.uint64(3) + now)


def word_counts(docs: DataFrame, sample_bits: int = SAMPLE_BITS) -> DataFrame:
    """(word, c): c of each word, of the end (an empty word), and of the bigrams whose key ends in sample_bits zeros (a
    blank and eight bytes). Counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def rows() -> list[pa.RecordBatch]:
            total = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
            held.clear()
            return pa.table({"word": total["word"], "c": total["c_sum"]}).to_batches(max_chunksize=1 << 16)

        for whole in batches:
            for batch in tx.pieces(whole):
                w = tx.words(batch.column("text"))
                now, before, _ = token_hashes(w, word_hashes(w.vocab))
                keys = pair_keys(before, now)
                sampled = [b" " + k.to_bytes(8, "little") for k in keys[keys & np.uint64((1 << sample_bits) - 1) == 0].tolist()]
                held.append(pa.table({"word": w.vocab.cast(pa.binary()), "c": np.bincount(w.codes, minlength=len(w.vocab))}))
                held.append(pa.table({"word": pa.array([b"", *sampled], pa.binary()), "c": np.array([batch.num_rows] + [1] * len(sampled))}))
                if sum(x.nbytes for x in held) > HELD_BYTES:
                    yield from rows()
        if held:
            yield from rows()

    return docs.select("text").mapInArrow(tidied(run), "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each of the keys once, sorted, and how often it occurs; held is emptied."""
    keys = np.concatenate(held)
    held.clear()
    keys.sort()
    ends = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    keys = keys[ends[:-1]]
    return keys, np.diff(ends)


def bigram_parts(docs: DataFrame, bucket_bits: int) -> DataFrame:
    """Bigrams of all texts as bloom.PACKED rows, counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for whole in batches:
            for batch in tx.pieces(whole, limit=PIECE_BYTES):
                w = tx.words(batch.column("text"))
                now, before, _ = token_hashes(w, word_hashes(w.vocab))
                held.append(pair_keys(before, now))
                if sum(map(len, held)) > FLUSH:
                    yield bloom.packed(*counted(held), bucket_bits)
        if held:
            yield bloom.packed(*counted(held), bucket_bits)

    return docs.select("text").mapInArrow(tidied(run), bloom.PACKED)


def word_parts(counts: DataFrame, bucket_bits: int) -> DataFrame:
    """Words with their counts as bloom.PACKED rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            h = np.where(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False), STOP, word_hashes(words))
            yield bloom.packed(*bloom.merged(bloom.mix(h ^ UNIGRAM), batch.column("c").to_numpy(zero_copy_only=False)), bucket_bits)

    return counts.mapInArrow(tidied(run), bloom.PACKED)


class Model:
    """n, v: training tokens and distinct ones; mass: the words' counts as the filter gives them back; least: the count
    from which on bigrams are in the filter; rare: (key, level) of the other bigrams, or None."""

    def __init__(self, raw: np.ndarray, n: int, v: int, mass: float, least: int = 1, rare: DataFrame | None = None):
        self.raw, self.n, self.v, self.mass, self.least, self.rare = raw, n, v, mass, least, rare
        self.weights = np.full(CLASSES, 0.5)

    def singles(self) -> np.ndarray:
        """Probability of a word of each level by its own count."""
        return (bloom.MIDDLE + 1) / (self.mass + self.v + 1)

    def log_probabilities(self) -> np.ndarray:
        """log10 of a token's probability in each cell."""
        before, own, both = np.meshgrid(*[bloom.MIDDLE] * 3, indexing="ij")
        weight = np.where(before > 0, self.weights[:, None, None], 0.0)
        return np.log10(weight * both / np.maximum(before, 1) + (1 - weight) * self.singles()[None, :, None]).ravel()

    def fit(self, cells: np.ndarray, counts: np.ndarray, rounds: int = 25) -> None:
        """Weights by expectation-maximisation over all tokens of the cells, each token's own occurrence taken out."""
        before, own, both = cells // CLASSES**2, cells // CLASSES % CLASSES, cells % CLASSES
        seen = before > 0
        before, own, both, counts = before[seen], own[seen], both[seen], counts[seen]
        pair = np.maximum(bloom.MIDDLE[both] - 1, 0) / np.maximum(bloom.MIDDLE[before] - 1, 1)
        single = np.maximum(bloom.MIDDLE[own], 1) / (self.mass + self.v + 1)
        size = np.bincount(before, counts, CLASSES)
        for _ in range(rounds):
            part = self.weights[before] * pair
            share = np.bincount(before, counts * part / (part + (1 - self.weights[before]) * single), CLASSES)
            self.weights = np.clip((share + 1) / (size + 4), 0.02, 0.98)


def count(docs: DataFrame, max_bytes: int = MAX_BYTES, bits_per_entry: int = BITS_PER_ENTRY, sample_bits: int = SAMPLE_BITS) -> tuple[Model, DataFrame]:
    """The model of docs' texts, weights not fitted yet, and their exact word counts (word, c). Null and empty texts hold
    the end token only, repeated rows count again, and an empty table gives an empty model."""
    all_counts = cut(word_counts(docs, sample_bits))
    is_word = F.substring("word", 1, 1) != F.lit(b" ")
    counts = all_counts.where(is_word)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = F.floor(F.log2("c")).cast("int")
    sampled = {r.j: r.k for r in all_counts.where(~is_word).groupBy(top.alias("j")).agg(F.count("*").alias("k")).collect()}
    # words' counts as the filter gives them back sum to `mass`, so that word probabilities sum to one
    words_in, mass = counts.agg(F.coalesce(F.sum(top + 1), F.lit(0)), F.coalesce(F.sum((3 * F.pow(F.lit(2.0), top) - 1) / 2), F.lit(0.0))).first()
    room, j = 8 * max_bytes / bits_per_entry, 0
    pairs_in = lambda j: (1 << sample_bits) * sum((k + 1) * c for k, c in sampled.items() if k >= j)
    while pairs_in(j) > room:
        j += 1
    size = -(-max(1 << 16, int((words_in + pairs_in(j)) * bits_per_entry / 8)) // bloom.UNIT) * bloom.UNIT
    bucket_bits = max(8, int(np.ceil(np.log2(max(n, 1) / (1 << 19)))))
    parts = bigram_parts(docs, bucket_bits)
    raw = bloom.build(parts, bucket_bits, size, 1 << j)
    raw |= bloom.build(word_parts(counts, bucket_bits), bucket_bits, size, 1)
    return Model(raw, n, v, mass, 1 << j, cut(bloom.below(parts, 1 << j)) if j else None), counts


PROBED = "id bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, cells binary, rare array<binary>, times array<bigint>, open array<bigint>, open_cells array<int>"


def probe(docs: DataFrame, model: Model, counts: DataFrame, held_out: Column, frequent: int = FREQUENT) -> DataFrame:
    """PROBED rows, one for each row of docs, written to the checkpoint folder: the one pass over texts and filter.

    Exact counts of the at most `frequent` most common words go with the tasks and are in n_known and base; the others
    are named in rare. open holds the keys of bigrams that the filter may lack, one for each token, open_cells the
    tokens' cells without the last level; such tokens are not in cells."""
    spark = docs.sparkSession
    powers = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("j")).agg(F.count("*").alias("k")).collect()
    floor = next((1 << j for j in range(63) if sum(r.k for r in powers if r.j >= j) <= frequent), 1 << 62)
    held = counts.where((F.col("c") >= floor) | (F.length("word") == 0)).toArrow()
    held_words = held.column("word").combine_chunks()
    held_hashes = word_hashes(held_words)
    order = np.argsort(held_hashes)
    common = spark.sparkContext.broadcast((held_hashes[order], held_words.take(pa.array(order)), held.column("c").to_numpy()[order]))
    raw, unit, least = spark.sparkContext.broadcast(model.raw), float(np.log10(model.n + model.v + 1)), model.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, (frequent_hashes, frequent_words, times_seen) = bloom.Filter(raw.value), common.value

        def exact(words: pa.Array, hashes: np.ndarray) -> np.ndarray:
            """Counts of the words that are among the frequent ones, -1 for others. The words themselves are compared: one
            that shares its hash counts as one of the others, whose counts are joined."""
            if not len(times_seen):
                return np.full(len(words), -1)
            at = np.minimum(np.searchsorted(frequent_hashes, hashes), len(times_seen) - 1)
            same = pc.equal(frequent_words.take(pa.array(at)), words)
            return np.where(same.to_numpy(zero_copy_only=False), times_seen[at], -1)

        end_word = pa.array([b""])
        end = max(int(exact(end_word, word_hashes(end_word))[0]), 0)
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in tx.pieces(whole, limit=tx.PIECE_BYTES // 2):
                w = tx.words(batch.column("text"))
                vocab, rows = w.vocab.cast(pa.binary()), batch.num_rows
                hashes = word_hashes(vocab)
                now, before, offsets = token_hashes(w, hashes)
                of = np.repeat(np.arange(rows), np.diff(offsets))
                words_level = kept.level(bloom.mix(np.append(hashes, STOP) ^ UNIGRAM))
                own = np.full(len(now), words_level[-1])
                if len(w.codes):
                    own[np.arange(len(w.codes)) + w.rows()] = words_level[w.codes]
                context = np.empty_like(own)
                context[1:] = own[:-1]
                context[offsets[:-1]] = words_level[-1]  # a text begins as often as one ends
                key = pair_keys(before, now)
                both = np.zeros_like(own)
                # each bigram once, in the order of the filter's segments: often repeated ones have the most levels to read
                once, of_once = np.unique(key[context > 0], return_inverse=True)
                both[context > 0] = kept.level(once)[of_once]
                both = np.minimum(both, np.minimum(context, own))
                cell = (context * CLASSES + own) * CLASSES + both
                is_open = (both == 0) & (context > 0) & (own > 0) if least > 1 else np.zeros(len(key), bool)
                open_starts = np.append(0, np.cumsum(is_open))[offsets].astype(np.int32)

                c = exact(vocab, hashes)
                per = c[w.codes]
                base = tx.sums(np.log10(np.maximum(c, 0) + 1)[w.codes], w.offsets) + np.log10(end + 1) - unit * (w.counts + 1)
                known = tx.sums((per > 0).astype(float), w.offsets).astype(np.int64) + (end > 0)
                word, times, starts = tx.grouped(w.rows()[per < 0], w.codes[per < 0], rows)
                starts = pa.array(starts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(rows)), batch.column("doc_id"), batch.column("held_out"), pa.array(w.counts + 1), pa.array(known), pa.array(base),
                        pa.array(tx.packed(*tx.grouped(of[~is_open], cell[~is_open], rows), CELL_BITS), pa.binary()),
                        pa.ListArray.from_arrays(starts, vocab.take(pa.array(word))), pa.ListArray.from_arrays(starts, pa.array(times)),
                        pa.ListArray.from_arrays(pa.array(open_starts), pa.array(key[is_open].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(open_starts), pa.array(cell[is_open].astype(np.int32))),
                    ],
                    names=[x.split()[0] for x in PROBED.split(", ")],
                )
                row += rows

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), "text")
    return cut(own.mapInArrow(tidied(run), PROBED))


def closed(probed: DataFrame, model: Model) -> DataFrame | None:
    """(id, held_out, doc_id, cell) of each open token, its bigram looked up; None if there are none by design."""
    if model.rare is None:
        return None
    tokens = probed.select("id", "held_out", "doc_id", F.explode(F.arrays_zip("open", "open_cells")).alias("x")).select(
        "id", "held_out", "doc_id", F.col("x.open").alias("key"), F.col("x.open_cells").alias("cell")
    )
    own, before = (F.col("cell") / CLASSES).cast("int") % CLASSES, (F.col("cell") / CLASSES**2).cast("int")
    found = F.least(F.coalesce("level", F.lit(0)), own, before)
    return tokens.join(model.rare, "key", "left").select("id", "held_out", "doc_id", (F.col("cell") + found).alias("cell"))


def fit(model: Model, probed: DataFrame) -> Model:
    """The model with weights from all texts that are not held out and have a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            cell, times, _ = tx.unpacked(batch.column("cells"), CELL_BITS)
            total += np.bincount(cell, times, CLASSES**3).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    learnt = "not held_out and doc_id is not null"
    cells, rest = probed.where(learnt).select("cells").mapInArrow(tidied(run), "cell int, n bigint"), closed(probed.where(learnt), model)
    if rest is not None:
        cells = cells.unionByName(rest.groupBy("cell").agg(F.count("*").alias("n")))
    table = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    model.fit(table.column("cell").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.float64))
    return model


def score(probed: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row per probed row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A text's rare words
    are joined with their counts, one row for each word and document."""
    sent = probed.sparkSession.sparkContext.broadcast(model.log_probabilities())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, times, starts = tx.unpacked(batch.column("cells"), CELL_BITS)
            yield batch.drop_columns(["cells"]).append_column("score", pa.array(tx.sums(sent.value[cell] * times, starts)))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sent.value[batch.column("cell").to_numpy()])], names=["id", "more"])

    rows = probed.drop("rare", "times", "open", "open_cells").mapInArrow(tidied(run), "id bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double")
    words = probed.select("id", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("id", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    more = words.join(counts, "word").groupBy("id").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("weight"), F.lit(0.0).alias("more"))
    rest = closed(probed, model)
    if rest is not None:
        pairs = rest.select("id", "cell").mapInArrow(single, "id bigint, more double").groupBy("id").agg(F.sum("more").alias("more"))
        more = more.unionByName(pairs.select("id", F.lit(0).cast("bigint").alias("known"), F.lit(0.0).alias("weight"), "more"))
        more = more.groupBy("id").agg(F.sum("known").alias("known"), F.sum("weight").alias("weight"), F.sum("more").alias("more"))
    return rows.join(more, "id", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(model.n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("weight", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
