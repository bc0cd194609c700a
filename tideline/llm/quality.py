"""Quality by co-training two classifiers that see different things.

One sees a text's words and the shapes they have, the other what is known of the page: its declared columns and its
layout (lengths, lines, repetition, shares of kinds of characters). One pass over the texts leaves each row's features;
all that follows reads those. In every round each classifier scores all rows without a label, the ones it is surest of
join the other's training rows, and both learn anew. Both are then calibrated on labelled rows kept back, weighted to the
labels' own shares, and their log-odds are added, less the prior's that both contain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import text as tx
from tideline.llm.spark_io import cut, sendable, tidied

BITS = 16
BUCKETS = 1 << BITS
#: Labelled rows of each class to train on (in expectation): the bound of what the driver holds, besides what rounds add.
ROWS_PER_CLASS = 1500
#: Rounds, and rows that each classifier hands to the other in a round.
ROUNDS, ADDED = 3, 100
#: Documents of a lower score are rejected.
THRESHOLD = 0.5
DECLARED = ("lang", "source", "n_chars")
KINDS = (r"\p{Lu}", r"\p{Ll}", r"\p{N}", r"[#$%&*<>|{}=_/\\]", r"[!?]", r"[.,;:]")
LAYOUT, DECLARED_BUCKETS = 14, 64
FEATURES = "doc_id bigint, text_hash bigint, row_hash bigint, words bigint, bag binary, page binary"


def word_features(vocab: pa.Array) -> np.ndarray:
    """Per word two hashed buckets: the lower-cased word, and its shape (kinds of letters, and the other signs)."""
    low = pc.utf8_lower(vocab).to_pylist()
    shape = vocab
    for kind, sign in ((r"\p{Lu}+", "X"), (r"\p{Ll}+", "x"), (r"\p{N}+", "9")):
        shape = pc.replace_substring_regex(shape, kind, sign)
    out = np.empty((len(vocab), 2), np.int64)
    for i, (w, s) in enumerate(zip(low, shape.to_pylist())):
        out[i] = xxhash.xxh32_intdigest(w) % BUCKETS, xxhash.xxh32_intdigest(s[:40], 1) % BUCKETS
    return out


def page_features(batch: pa.RecordBatch, w: tx.Words) -> np.ndarray:
    """Per text LAYOUT numbers about its layout, then a hashed bucket for each declared column (-1 where there is none)."""
    texts, rows = pc.fill_null(batch.column("text"), ""), w.rows()
    n = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float), 1)
    length = pc.utf8_length(w.vocab).to_numpy(zero_copy_only=False)
    share = []
    for kind in KINDS:
        per_word = length - pc.utf8_length(pc.replace_substring_regex(w.vocab, kind, "")).to_numpy(zero_copy_only=False)
        share.append(np.bincount(rows, per_word[w.codes], len(n)) / n if len(rows) else np.zeros(len(n)))
    lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1.0
    words = np.maximum(w.counts, 1).astype(float)
    distinct = np.bincount(np.unique(rows * max(len(w.vocab), 1) + w.codes) // max(len(w.vocab), 1), minlength=len(n))
    repeated = np.array([1 - len(set(own := t.split("\n"))) / len(own) for t in texts.to_pylist()])
    layout = [np.log(n), np.log(lines), np.log(words), n / words / 10, words / lines / 50, distinct / words, repeated, (w.counts == 0).astype(float), *share]
    declared = np.full((len(n), len(DECLARED)), -1.0)
    for k, c in enumerate(DECLARED):
        if c not in batch.schema.names:
            continue
        for i, v in enumerate(batch.column(c).to_pylist()):
            key = f"{c}={'' if v is None else int(np.log2(max(v, 1))) if c == 'n_chars' else v}"
            declared[i, k] = xxhash.xxh32_intdigest(key) % DECLARED_BUCKETS
    return np.concatenate([np.stack(layout, axis=1), declared], axis=1).astype("<f4")


@dataclass
class Rows:
    """Features of some rows: cells and times of each row's bag (runs begin at starts), its words, its page features."""

    cells: np.ndarray
    times: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    page: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch | pa.Table) -> Rows:
        """From FEATURES."""
        cells, times, starts = tx.unpacked(batch.column("bag"), BITS)
        page = np.frombuffer(b"".join(batch.column("page").to_pylist()), "<f4").reshape(-1, LAYOUT + len(DECLARED)).astype(float)
        return Rows(cells, times, starts, batch.column("words").to_numpy(), page)

    @staticmethod
    def read(batch: pa.RecordBatch) -> Rows:
        """From texts."""
        w = tx.words(batch.column("text"), lower=False)
        spell, rows = word_features(w.vocab), np.repeat(w.rows(), 2)
        cells, times, starts = tx.grouped(rows, spell[w.codes].ravel(), batch.num_rows)
        return Rows(cells, times, starts, w.counts, page_features(batch, w).astype(float))

    def __len__(self) -> int:
        return len(self.words)

    def __add__(self, other: Rows) -> Rows:
        return Rows(
            np.append(self.cells, other.cells), np.append(self.times, other.times), np.append(self.starts, other.starts[1:] + self.starts[-1]),
            np.append(self.words, other.words), np.concatenate([self.page, other.page]),
        )

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return Rows(self.cells[at], self.times[at], np.append(0, np.cumsum(sizes)), self.words[rows], self.page[rows])

    def shares(self) -> np.ndarray:
        """Of each cell, how often it occurs for each word of its row."""
        return self.times / np.repeat(np.maximum(self.words, 1), np.diff(self.starts))

    def columns(self) -> np.ndarray:
        """Page features with a column for each bucket of the declared ones."""
        declared = np.zeros((len(self), DECLARED_BUCKETS))
        i, k = np.nonzero(self.page[:, LAYOUT:] >= 0)
        declared[i, self.page[i, LAYOUT + k].astype(int)] = 1
        return np.concatenate([self.page[:, :LAYOUT], declared], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Content:
    """Logistic model of a text's mean word: a weight for each bucket."""

    weights: np.ndarray
    bias: float = 0.0

    def logits(self, x: Rows) -> np.ndarray:
        return tx.sums(self.weights[x.cells] * x.shares(), x.starts) + self.bias

    @staticmethod
    def fit(x: Rows, y: np.ndarray, epochs: int = 8, batch: int = 32, seed: int = 1) -> Content:
        """Adagrad on the logistic loss."""
        own, r = Content(np.zeros(BUCKETS)), np.random.default_rng(seed)
        past, bias_past = np.full(BUCKETS, 1e-8), 1e-8
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(order), batch):
                some = x.take(order[a : a + batch])
                err = (sigmoid(own.logits(some)) - y[order[a : a + batch]]) / len(some)
                at, back = np.unique(some.cells, return_inverse=True)
                grad = np.bincount(back, some.shares() * np.repeat(err, np.diff(some.starts)), len(at))
                past[at] += grad**2
                own.weights[at] -= 0.2 * grad / np.sqrt(past[at])
                bias_past += err.sum() ** 2
                own.bias -= 0.05 * err.sum() / np.sqrt(bias_past)
        return own


@dataclass
class Page:
    """Logistic model of standardised page features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float = 0.0

    def logits(self, x: Rows) -> np.ndarray:
        return (x.columns() - self.mean) / self.scale @ self.weights + self.bias

    @staticmethod
    def fit(rows: Rows, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> Page:
        """Newton steps on the ridge-penalised logistic loss."""
        x = rows.columns()
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
        b = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = sigmoid(z @ b)
            grad = z.T @ (p - y) / len(y) + ridge * b
            hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(b))
            step = np.linalg.solve(hess, grad)
            b -= step
            if np.abs(step).max() < 1e-6:
                break
        return Page(mean, scale, b[:-1], float(b[-1]))


def platt(logits: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b so that sigmoid(a * logit + b) are probabilities of label 1 among rows of these weights; a is kept positive."""
    a, b, w = 1.0, 0.0, weight / weight.sum()
    for _ in range(rounds):
        p = sigmoid(a * logits + b)
        err, v = w * (p - y), w * p * (1 - p)
        grad = np.array([err @ logits + 1e-3 * (a - 1), err.sum() + 1e-3 * b])
        hess = np.array([[v @ logits**2 + 1e-3, v @ logits], [v @ logits, v.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(a, 1e-3)), float(b)


@dataclass
class Classifier:
    """prior: log-odds of label 1 among the labels, which both views' log-odds contain."""

    content: Content
    page: Page
    content_scale: tuple[float, float] = (1.0, 0.0)
    page_scale: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.0

    def scores(self, x: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, content's and page's probability of good quality."""
        c = self.content_scale[0] * self.content.logits(x) + self.content_scale[1]
        p = self.page_scale[0] * self.page.logits(x) + self.page_scale[1]
        return sigmoid(c + p - self.prior), sigmoid(c), sigmoid(p)


def untaught() -> Classifier:
    width = LAYOUT + DECLARED_BUCKETS
    return Classifier(Content(np.zeros(BUCKETS)), Page(np.zeros(width), np.ones(width), np.zeros(width)))


#: (learner, label, rows) for each of the four kinds of rows that a round hands over: learner 0 is the content view.
Picked = list[tuple[int, int, Rows]]


def co_train(rows: Rows, y: np.ndarray, totals: tuple[float, float], pick: Callable[[Content, Page, int, int], Picked], rounds: int = ROUNDS, added: int = ADDED) -> Classifier:
    """rows with labels y; totals: labels 0 and 1 in all. pick gives the rows without a label that each view is surest of:
    so many of label 0 and of label 1 for the other. Every fourth labelled row calibrates; an even chance for all where
    there are not both labels."""
    spare, base = np.arange(0, len(y), 4), np.flatnonzero(np.arange(len(y)) % 4)
    if len(set(y[base].tolist())) < 2 or len(set(y[spare].tolist())) < 2:
        return untaught()
    taught = [[rows.take(base), y[base].astype(float)] for _ in range(2)]
    prior = totals[1] / sum(totals)
    for n in range(rounds + 1):
        content, page = Content.fit(*taught[0]), Page.fit(*taught[1])
        if n == rounds:
            break
        for learner, label, more in pick(content, page, int(added * (1 - prior)) + 1, int(added * prior) + 1):
            if len(more):
                taught[learner] = [taught[learner][0] + more, np.append(taught[learner][1], np.full(len(more), float(label)))]
    held = rows.take(spare)
    weight = np.array([totals[k] / max((y[spare] == k).sum(), 1) for k in (0, 1)])[y[spare]]
    scales = [platt(view.logits(held), y[spare], weight) for view in (content, page)]
    return Classifier(content, page, *scales, float(np.log(totals[1] / totals[0])))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def row_hash(docs: DataFrame) -> Column:
    """Hash of all that a score depends on."""
    return F.xxhash64(text_hash(), F.col("text").isNull(), *[F.col(c).cast("string") for c in DECLARED if c in docs.columns])


def features(docs: DataFrame) -> DataFrame:
    """FEATURES of every row, written to the checkpoint folder. A null text counts as empty, a missing or null declared
    column as a value of its own; repeated rows and rows without doc_id stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole, limit=tx.PIECE_BYTES // 3):
                x = Rows.read(batch)
                bags = tx.packed(x.cells, x.times, x.starts, BITS)
                pages = [p.astype("<f4").tobytes() for p in x.page]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("doc_id", "text_hash", "row_hash")], pa.array(x.words), pa.array(bags, pa.binary()), pa.array(pages, pa.binary())],
                    names=[f.split()[0] for f in FEATURES.split(", ")]
                )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("text_hash"), row_hash(docs).alias("row_hash"), "text", *[c for c in DECLARED if c in docs.columns])
    return cut(own.mapInArrow(tidied(run), FEATURES))


def picker(seen: DataFrame, known: DataFrame) -> Callable[[Content, Page, int, int], Picked]:
    """pick for co_train over all rows of `seen` (FEATURES) whose doc_id has no label. Of rows with equal text one takes
    part; what was handed over once is not handed over again."""
    spark, used = seen.sparkSession, {0}

    def pick(content: Content, page: Page, low: int, high: int) -> Picked:
        sent = spark.sparkContext.broadcast((content, page))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = Rows.of(batch)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *[pa.array(v.logits(x)) for v in sent.value]], names=["doc_id", "text_hash", "v0", "v1"])

        scored = seen.where("doc_id is not null").mapInArrow(tidied(run), "doc_id bigint, text_hash bigint, v0 double, v1 double").join(known.select("doc_id"), "doc_id", "left_anti")
        pool = cut(scored.groupBy("text_hash").agg(F.min(F.struct("doc_id", "v0", "v1")).alias("x")).where(~F.col("text_hash").isin(*used)).select("text_hash", "x.*"))
        chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for teacher in (0, 1):
            v = F.col(f"v{teacher}")
            for label, order, sure, k in ((0, v.asc(), v < 0, low), (1, v.desc(), v > 0, high)):
                chosen[1 - teacher, label] = [(r.doc_id, r.text_hash) for r in pool.where(sure).orderBy(order, "text_hash").limit(k).collect()]
        used.update(h for rows in chosen.values() for _, h in rows)
        keys = sorted({k for rows in chosen.values() for k in rows})
        if not keys:
            return []
        wanted = F.broadcast(spark.createDataFrame(keys, "doc_id bigint, text_hash bigint"))
        table = seen.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).toArrow()
        place = {k: i for i, k in enumerate(zip(table.column("doc_id").to_pylist(), table.column("text_hash").to_pylist()))}
        x = Rows.of(table)
        return [(learner, label, x.take(np.array([place[k] for k in rows], np.int64))) for (learner, label), rows in chosen.items()]

    return pick


def learn(seen: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, rounds: int = ROUNDS, added: int = ADDED) -> Classifier:
    """A classifier from FEATURES of all documents: about `rows_per_class` labelled ones of each quality and all of those
    without a label. Labels other than 0 and 1 are left out; of several labels of one doc_id the smallest counts, of
    several rows of one labelled doc_id one teaches. Empty tables give an even chance for all."""
    known = cut(labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_y")))
    counted = {r._y: r["count"] for r in known.groupBy("_y").count().collect()}
    chosen = F.broadcast(tx.thin(known, ["_y"], "doc_id", rows_per_class))
    rows = seen.join(chosen, "doc_id").groupBy("doc_id", "_y").agg(F.min(F.struct("text_hash", "words", "bag", "page")).alias("x"))
    table = rows.select("_y", "x.*").orderBy(F.xxhash64("doc_id", F.lit(9))).toArrow()
    return co_train(Rows.of(table), table.column("_y").to_numpy().astype(np.int64), (counted.get(0, 0), counted.get(1, 0)), picker(seen, known), rounds, added)


def train(docs: DataFrame, labels: DataFrame, **how) -> Classifier:
    """`learn` from documents; rows with null text take part as empty ones."""
    return learn(features(docs), labels, **how)


SCORES = ("score", "content_score", "metadata_score")


def _scored(df: DataFrame, model: Classifier, read: Callable[[pa.RecordBatch], Rows], keep: list[str], threshold: float) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole, "text") if "text" in whole.schema.names else [whole]:
                s = sent.value.scores(read(batch))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *map(pa.array, s), pa.array((s[0] >= threshold).astype(np.int32))], names=[*keep, *SCORES, "predicted"])

    return df.mapInArrow(tidied(run), fields + ", score double, content_score double, metadata_score double, predicted int")


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (probability of good quality), content_score, metadata_score and predicted (1 from the threshold
    on); columns of these names are replaced. Every row is scored: a null text counts as empty, a missing or null column
    as one value of its own."""
    docs = docs.drop(*SCORES, "predicted")
    return _scored(docs, model, Rows.read, docs.columns, threshold)


def score_features(seen: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and row_hash with the columns of `score`, from FEATURES."""
    return _scored(seen, model, Rows.of, ["doc_id", "row_hash"], threshold)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of docs that a classifier learnt from docs and labels does not reject, with all their columns, whatever
    they are called. Null and empty texts are judged like others, and equal rows alike. Texts are taken apart once; the
    rejected rows, known by doc_id and a hash of the rest, are taken out by a join."""
    inner = docs.toDF(*[c if c in ("doc_id", "text", *DECLARED) else f"c{i}" for i, c in enumerate(docs.columns)])
    seen = features(inner)
    out = score_features(seen, learn(seen, labels, **how), threshold).where("predicted = 0")
    out = cut(out.select(F.col("doc_id").alias("_d"), F.col("row_hash").alias("_h")).distinct())
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_d")) & (row_hash(inner) == F.col("_h"))
    return inner.join(sendable(out), same, "left_anti").toDF(*docs.columns)
