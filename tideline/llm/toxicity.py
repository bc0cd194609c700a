"""Toxicity by a convolutional text classifier.

A word's vector is the sum of hashed vectors of the word and of its first letters; filters of several widths run over
the whole text, and the largest response of each filter goes into a logistic output. It is trained in numpy on a bounded
sample of labelled rows. Thresholds are set for each language on all labelled rows kept back from training, so that the
share of toxic rows missed plus twice the share of clean rows taken for toxic is least; the language is what `langid` makes
of the text, and a score is shifted so that 0.5 is its language's threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import langid
from tideline.llm import text as tx
from tideline.llm.spark_io import cut

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 6, (1, 2, 3)
#: Labelled rows of each class to train on (in expectation): the bound of what the driver holds.
ROWS_PER_CLASS = 4000
#: What a clean row taken for toxic costs, a toxic row missed costing 1; rates, so that class sizes do not count.
FALSE_COST = 2.0
#: One of this many labelled rows sets thresholds and is not learned from; rows of a class that a language's own threshold needs.
HELD_BACK, LEAST = 4, 20
EPOCHS, BATCH, RATE = 4, 32, 0.05
PREFIXES = (4, 5, 6)
PAD = -1


def features(vocab: pa.Array) -> np.ndarray:
    """Per word its hashed buckets: the word's letters and each of its beginnings (the word again where it is shorter)."""
    bare = pc.utf8_trim(pc.utf8_lower(vocab), characters=".,;:!?\"'()[]{}*#$%&|<>-_/\\")
    out = np.empty((len(vocab), 1 + len(PREFIXES)), np.int64)
    for i, w in enumerate(bare.to_pylist()):
        out[i, 0] = xxhash.xxh32_intdigest(w) % BUCKETS
        for k, n in enumerate(PREFIXES):
            out[i, k + 1] = xxhash.xxh32_intdigest(w[:n], n) % BUCKETS
    return out


def padded(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes with PAD after each text, so that no window reaches into the next one; and where texts begin."""
    gap = max(WIDTHS)
    n = len(offsets) - 1
    out = np.full(len(codes) + gap * n, PAD)
    out[np.arange(len(codes)) + gap * np.repeat(np.arange(n), np.diff(offsets))] = codes
    return out, offsets + gap * np.arange(n + 1)


@dataclass
class Network:
    embed: np.ndarray  # buckets x DIM
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: langid.Model
    shift: np.ndarray  # per language, and for texts of none, what is taken off the logit

    @staticmethod
    def fresh(languages: langid.Model, seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        return Network(
            r.normal(0, 0.05, (BUCKETS, DIM)),
            [r.normal(0, 0.5, (w, DIM, FILTERS)) for w in WIDTHS],
            [np.zeros(FILTERS) for _ in WIDTHS],
            r.normal(0, 0.3, len(WIDTHS) * FILTERS),
            0.0,
            languages,
            np.zeros(len(languages.names) + 1),
        )

    def responses(self, vectors: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each text. vectors: of the vocabulary, with zeros at the end for PAD."""
        pooled = []
        # of the windows that start after a text's last word, only the first takes part: it holds nothing but PAD
        starts = np.stack([offsets[:-1], offsets[1:] - max(WIDTHS) + 1], axis=1).ravel()
        for weight, bias in zip(self.filters, self.bias):
            per_word = np.einsum("vd,wdf->wvf", vectors, weight, optimize=True)
            total = per_word[0][codes]
            for k in range(1, len(weight)):
                total[:-k] += per_word[k][codes[k:]]
            pooled.append(np.maximum(np.maximum.reduceat(total, starts, axis=0)[::2] + bias, 0))
        return np.concatenate(pooled, axis=1)

    def logits(self, spell: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """spell: `features` of the vocabulary that the codes of the texts' words are of."""
        if len(offsets) < 2:
            return np.zeros(0)
        vectors = np.concatenate([self.embed[spell].sum(axis=1), np.zeros((1, DIM))])
        return self.responses(vectors, *padded(codes, offsets)) @ self.out + self.out_bias

    def scores(self, w: tx.Words) -> np.ndarray:
        logit = self.logits(features(w.vocab), w.codes, w.offsets) - self.shift[self.languages.best(w)]
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


@dataclass
class Sample:
    """Labelled texts: text i has the words codes[offsets[i]:offsets[i + 1]], which are rows of spell; each text has rows
    of its own there, one for each distinct word."""

    spell: np.ndarray
    codes: np.ndarray
    offsets: np.ndarray
    words_of: np.ndarray  # the text of each row of spell
    labels: np.ndarray
    language: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Sample:
        spells = [np.frombuffer(x, "<i4").reshape(-1, 1 + len(PREFIXES)) for x in table.column("spell").to_pylist()]
        codes = [np.frombuffer(x, "<i4") for x in table.column("codes").to_pylist()]
        first = np.append(0, np.cumsum([len(x) for x in spells])).astype(np.int64)
        return Sample(
            np.concatenate([np.zeros((0, 1 + len(PREFIXES)), np.int32), *spells]), np.concatenate([np.zeros(0, np.int64), *[c + at for c, at in zip(codes, first)]]),
            np.append(0, np.cumsum([len(c) for c in codes])).astype(np.int64), np.repeat(np.arange(len(spells)), np.diff(first)),
            table.column("y").to_numpy().astype(np.int64), table.column("language").to_numpy().astype(np.int64),
        )

    def take(self, rows: np.ndarray) -> Sample:
        words = np.isin(self.words_of, rows)
        place = np.cumsum(words) - 1
        at = np.concatenate([np.zeros(0, np.int64), *[np.arange(self.offsets[i], self.offsets[i + 1]) for i in rows]])
        row = np.full(len(self.labels), -1)
        row[rows] = np.arange(len(rows))
        return Sample(self.spell[words], place[self.codes[at]], np.append(0, np.cumsum(np.diff(self.offsets)[rows])), row[self.words_of[words]], self.labels[rows], self.language[rows])

    def logits(self, net: Network, step: int = 256) -> np.ndarray:
        parts = [self.take(np.arange(a, min(a + step, len(self.labels)))) for a in range(0, len(self.labels), step)]
        return np.concatenate([np.zeros(0), *[net.logits(p.spell, p.codes, p.offsets) for p in parts]])


def gradients(net: Network, spelled: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple:
    """Of the mean logistic loss of some texts: for filters, biases, output, its bias, and (buckets, their rows) of embed.
    codes: the texts' padded words one after another, text i from starts[i] on; spelled: buckets of each word, PAD last.
    A filter's gradient reaches the window that gave its largest response."""
    x = np.where((codes >= 0)[:, None], net.embed[spelled[codes]].sum(axis=1), 0.0)
    best, pooled = [], []
    for weight, bias in zip(net.filters, net.bias):
        total = x @ weight[0]
        for k in range(1, len(weight)):
            total[:-k] += x[k:] @ weight[k]
        at = np.stack([s + total[s : s + n - max(WIDTHS) + 1].argmax(axis=0) for s, n in zip(starts, sizes)])
        best.append(at)
        pooled.append(np.maximum(np.take_along_axis(total, at, axis=0) + bias, 0))
    hidden = np.concatenate(pooled, axis=1)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30)))
    err = (p - labels) / len(labels)
    back = err[:, None] * net.out[None, :] * (hidden > 0)
    of_filters, of_bias, touched, moves = [], [], [], []
    for j, weight in enumerate(net.filters):
        g = back[:, j * FILTERS : (j + 1) * FILTERS]
        gw = np.zeros_like(weight)
        for k in range(len(weight)):
            at = np.minimum(best[j] + k, len(x) - 1)
            gw[k] = np.einsum("bf,bfd->df", g, x[at])
            touched.append(codes[at].ravel())
            moves.append((g[:, :, None] * weight[k].T[None]).reshape(-1, DIM))
        of_filters.append(gw)
        of_bias.append(g.sum(axis=0))
    words, move = np.concatenate(touched), np.concatenate(moves)
    live = (words >= 0) & (np.abs(move).sum(axis=1) > 0)
    cells, back_to = np.unique(spelled[words[live]].ravel(), return_inverse=True)
    summed = np.zeros((len(cells), DIM))
    np.add.at(summed, back_to, np.repeat(move[live], spelled.shape[1], axis=0))
    return of_filters, of_bias, hidden.T @ err, err.sum(), (cells, summed)


def fit(own: Sample, languages: langid.Model, seed: int = 1) -> Network:
    """Adagrad on the logistic loss. The first coordinate of a bucket starts at the log-odds of its words among the
    labelled texts, which half of the filters of each width start by reading."""
    net, r = Network.fresh(languages, seed), np.random.default_rng(seed)
    codes, offsets = padded(own.codes, own.offsets)
    kind = own.labels[own.words_of]
    hit = [sum(np.bincount(own.spell[kind == y, k], minlength=BUCKETS) for k in range(own.spell.shape[1])) for y in (0, 1)]
    totals = [max(1, int((own.labels == k).sum())) for k in (0, 1)]
    odds = np.log((hit[1] + 1) / (totals[1] + 2)) - np.log((hit[0] + 1) / (totals[0] + 2))
    net.embed[:, 0] = np.clip(odds, -2, 4) * (hit[0] + hit[1] >= 3) / own.spell.shape[1]
    for weight in net.filters:
        weight[0, 0, : FILTERS // 2] = 1.0
    params = [*net.filters, *net.bias, net.out]
    past = [np.full(p.shape, 1e-6) for p in params]
    embed_past, bias_past = np.full(net.embed.shape, 1e-6), 1e-6
    spelled = np.concatenate([own.spell, np.full((1, own.spell.shape[1]), -1, own.spell.dtype)])
    for _ in range(EPOCHS):
        order = r.permutation(len(own.labels))
        for a in range(0, len(order), BATCH):
            texts = order[a : a + BATCH]
            at = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in texts])
            sizes = offsets[texts + 1] - offsets[texts]
            of_filters, of_bias, of_out, of_out_bias, (cells, move) = gradients(net, spelled, codes[at], np.append(0, np.cumsum(sizes)[:-1]), sizes, own.labels[texts])
            for param, before, grad in zip(params, past, [*of_filters, *of_bias, of_out]):
                before += grad**2
                param -= RATE * grad / np.sqrt(before)
            bias_past += of_out_bias**2
            net.out_bias -= RATE * of_out_bias / np.sqrt(bias_past)
            embed_past[cells] += move**2
            net.embed[cells] -= RATE * move / np.sqrt(embed_past[cells])
    return net


def threshold(logit: np.ndarray, labels: np.ndarray, false_cost: float = FALSE_COST) -> float:
    """Where the share of label 1 below plus `false_cost` times the share of label 0 from there on is least: the middle
    of the gap, of the widest one where there are several."""
    order = np.argsort(logit, kind="stable")
    x, y = logit[order], labels[order].astype(float)
    missed, false = np.append(0, np.cumsum(y)) / max(y.sum(), 1), 1 - np.append(0, np.cumsum(1 - y)) / max((1 - y).sum(), 1)
    loss = missed + false_cost * false
    loss[1:-1][x[1:] == x[:-1]] = np.inf  # no threshold parts equal logits
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    edge = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    widest = best[np.argmax(edge[best + 1] - edge[best])]
    return float((edge[widest] + edge[widest + 1]) / 2)


def calibrate(net: Network, own: Sample, least: int = LEAST) -> None:
    """Thresholds from a few rows that are at hand; `calibrate_on_all` sets them from any number."""
    logit, found = own.logits(net), {}
    for k in [None, *range(len(net.shift))]:
        at = np.full(len(own.labels), True) if k is None else own.language == k
        ones, zeros = own.labels[at].sum(), (1 - own.labels[at]).sum()
        found[k] = (int(ones), int(zeros), threshold(logit[at], own.labels[at]) if min(ones, zeros) > 0 else 0.0)
    shift(net, found, least)


def shift(net: Network, found: dict[int | None, tuple[int, int, float]], least: int) -> None:
    """found: rows of label 1, of label 0 and the threshold of each language, and under None of all rows, which a language
    with fewer than `least` rows of a class takes."""
    ones, zeros, common = found.get(None, (0, 0, 0.0))
    net.shift[:] = common if min(ones, zeros) > 0 else 0.0
    for k, (ones, zeros, own) in found.items():
        if k is not None and min(ones, zeros) >= least:
            net.shift[k] = own


def thresholds(rows: DataFrame, false_cost: float = FALSE_COST) -> dict[int | None, tuple[int, int, float]]:
    """What `shift` takes, from (language, logit, y) of any number of rows: `threshold` of each language and of all rows.
    Logits are dealt out in order; what lies before a part is added to sums within it, so no task sorts a language."""
    both = rows.select(F.explode(F.array("language", F.lit(None).cast("int"))).alias("language"), "logit", "y")
    counts = both.groupBy("language", "logit").agg(F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros"))
    held = cut(counts.repartitionByRange("language", "logit")).withColumn("part", F.spark_partition_id())
    sums = held.groupBy("part", "language").agg(F.sum("ones"), F.sum("zeros"), F.max("logit")).orderBy("language", "part").collect()  # one row for each part and language
    total: dict = {}
    for _, language, ones, zeros, _ in sums:
        before = total.get(language, (0, 0))
        total[language] = before[0] + ones, before[1] + zeros
    seen, starts = {}, []
    for part, language, ones, zeros, high in sums:
        before = seen.get(language, (0, 0, None))
        starts.append((part, language, *before, *total[language]))
        seen[language] = before[0] + ones, before[1] + zeros, high
    if not starts:
        return {}
    places = held.sparkSession.createDataFrame(starts, "part int, language int, ones_before long, zeros_before long, low double, all_ones long, all_zeros long")
    within = Window.partitionBy("part", "language").orderBy("logit")
    below = within.rowsBetween(Window.unboundedPreceding, -1)
    missed = F.col("ones_before") + F.coalesce(F.sum("ones").over(below), F.lit(0))
    right = F.col("zeros_before") + F.coalesce(F.sum("zeros").over(below), F.lit(0))
    walked = held.withColumnsRenamed({"part": "_part", "language": "_language"}).join(
        F.broadcast(places), (F.col("_part") == F.col("part")) & F.col("_language").eqNullSafe(F.col("language"))
    )
    # losses times both class sizes: whole numbers, so that equal ones are equal
    loss = missed * F.col("all_zeros").cast("double") + false_cost * (F.col("all_zeros") - right) * F.col("all_ones").cast("double")
    gap = walked.select("language", loss.alias("loss"), F.coalesce(F.lag("logit").over(within), "low", F.col("logit") - 1).alias("low"), F.col("logit").alias("high"))
    best = gap.groupBy("language").agg(F.max_by(F.struct("loss", "low", "high"), F.struct(-F.col("loss"), F.col("high") - F.col("low"), -F.col("high"))).alias("x")).select("language", "x.*").collect()  # one row for each language
    out = {}
    for language, least, low, high in best:
        ones, zeros = total[language]
        last = seen[language][2]
        last_loss = float(ones) * zeros
        if (last_loss, -1.0) < (least, low - high):
            low, high = last, last + 1
        out[language] = ones, zeros, (low + high) / 2
    return out


def calibrate_on_all(net: Network, docs: DataFrame, known: DataFrame, least: int = LEAST) -> None:
    """Thresholds from every row of docs that is labelled in known (doc_id, _y) and held back. Tasks make logits; texts stay
    where they are, and rows of a document, its language and its logit meet the labels. Of several rows of one doc_id one
    takes part."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                w = tx.words(batch.column("text"))
                logit, language = sent.value.logits(features(w.vocab), w.codes, w.offsets), sent.value.languages.best(w)
                columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(language.astype(np.int32)), pa.array(logit)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "language", "logit"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").where(held_back(F.col("doc_id")))
    judged = own.mapInArrow(run, "doc_id bigint, text_hash bigint, language int, logit double")
    rows = judged.join(known.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_y").cast("int").alias("y")), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text_hash", "y", "language", "logit")).alias("x"))
    shift(net, thresholds(one.select("x.language", "x.logit", "x.y")), least)


def held_back(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("bigint"), F.lit(9)), F.lit(HELD_BACK)) == 0


SAMPLE = "doc_id bigint, y int, text_hash bigint, language int, spell binary, codes binary"


def sample(docs: DataFrame, chosen: DataFrame, languages: langid.Model) -> Sample:
    """Hashed words of the documents named in chosen (doc_id, _y), read in the tasks: no text reaches the driver. Of
    several rows of one doc_id one takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                w = tx.words(batch.column("text"))
                spell, language, spells, codes = features(w.vocab).astype("<i4"), languages.best(w), [], []
                for a, b in zip(w.offsets[:-1], w.offsets[1:]):
                    distinct, back = np.unique(w.codes[a:b], return_inverse=True)
                    spells.append(spell[distinct].tobytes())
                    codes.append(back.astype("<i4").tobytes())
                columns = [batch.column("doc_id"), batch.column("_y"), batch.column("text_hash"), pa.array(language.astype(np.int32)), pa.array(spells, pa.binary()), pa.array(codes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SAMPLE.split(", ")])

    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").join(F.broadcast(chosen), "doc_id")
    rows = named.select("doc_id", F.col("_y").cast("int").alias("_y"), "text_hash", "text").mapInArrow(run, SAMPLE)
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text_hash", "y", "language", "spell", "codes")).alias("x"))
    return Sample.of(one.select("x.*", "doc_id").orderBy(F.xxhash64("doc_id", F.lit(9))).toArrow())


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> Network:
    """A network from about `rows_per_class` labelled rows of each class, languages from all of docs, and thresholds from
    all labelled rows that are held back, which is every fourth by its hash. Labels other than 0 and 1 and null doc_ids are
    left out; of several labels of one doc_id the largest counts. A null text is an empty one. Without labels a network that
    was taught nothing."""
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).alias("_y"))
    languages = langid.train(docs) if "lang" in docs.columns else langid.Model([], np.zeros((0, 0)))
    own = sample(docs, tx.thin(known.where(~held_back(F.col("doc_id"))), ["_y"], "doc_id", rows_per_class), languages)
    net = fit(own, languages) if len(own.labels) else Network.fresh(languages)
    calibrate_on_all(net, docs, known.where(held_back(F.col("doc_id"))))
    return net


def score(docs: DataFrame, net: Network, held_out: Column) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0.5 is the threshold of the text's language), predicted. A null
    text counts as empty; an empty one gets the score of a text in which no filter responds to a word."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                s = sent.value.scores(tx.words(batch.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"]
                )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
