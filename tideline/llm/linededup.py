"""Repeated passages of lines, removed everywhere but where they come first.

A text's lines are cut into chunks where a rolling hash over line hashes says so, so that a passage is cut alike wherever
it stands. Within a chunk every run of lines is looked at, since a passage may begin or end inside one: runs of at least
two lines, and single lines of many words. Passages of over PASSAGE_WORDS words are found wherever chunks end: each line
begins a shortest run of so many words and ends one, and these cover every such passage whole. A shorter passage's first or
last lines that fall into other chunks are joined to it if they too come first in the same place. Runs that occur more than once over all documents are compared byte by byte;
each stays where it comes first (by doc_id, then position) and goes from everywhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import text as tx
from tideline.llm.spark_io import cut, sendable, tidied

#: A line ends a chunk if the rolling hash of the WINDOW lines up to it is 0 modulo DIVISOR; LONGEST lines end one anyway.
DIVISOR, LONGEST, WINDOW = 3, 8, 2
#: Words that a run must have to be removed by itself: one line alone, and several lines together.
LINE_WORDS, RUN_WORDS = 50, 20
#: Several lines with more words than these together are removed whatever chunks they lie in.
PASSAGE_WORDS = 50

RUNS = "hash bigint, doc_id bigint, text_hash bigint, start int, lines int, strong boolean"


def ends(hashes: list[int], divisor: int = DIVISOR, longest: int = LONGEST, window: int = WINDOW) -> list[int]:
    """Where chunks end, one past their last line. The rolling hash is the sum of the last `window` line hashes, so two
    texts agree on ends again `window` lines into a common passage."""
    out, since, rolling = [], 0, 0
    for i, h in enumerate(hashes):
        rolling += h - (hashes[i - window] if i >= window else 0)
        since += 1
        if (rolling >> 7) % divisor == 0 or since == longest:
            out.append(i + 1)
            since = 0
    if since:
        out.append(len(hashes))
    return out


def spans(words: list[int], passage_words: int = PASSAGE_WORDS) -> set[tuple[int, int]]:
    """(first, last) of each shortest run of lines with over `passage_words` words from a line on and up to a line.

    A passage of more words begins with one and ends with one. Each of its lines either begins one that ends in the
    passage or lies in the one that the passage ends with."""
    full = [i for i, w in enumerate(words) if w]
    total = np.cumsum([0, *[words[i] for i in full]])
    last = np.searchsorted(total, total[:-1] + passage_words, side="right") - 1
    first = np.searchsorted(total, total[1:] - passage_words, side="left") - 1
    out = {(i, full[j]) for i, j in zip(full, last.tolist()) if j < len(full)}
    return {(i, j) for i, j in out | {(full[i], j) for i, j in zip(first.tolist(), full) if i >= 0} if i < j}


def runs(content: str, divisor: int = DIVISOR, longest: int = LONGEST, window: int = WINDOW, line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> list[tuple[int, int, int, bool]]:
    """(hash, first line, lines, strong) of every line, every run of lines within a chunk and every run of `spans`;
    strong: enough words."""
    lines = content.encode("utf-8").split(b"\n")
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    raw = np.array(hashes, "<u8").tobytes()
    words = [len(x.split()) for x in lines]
    out, a, long = [], 0, spans(words)
    for b in ends(hashes, divisor, longest, window):
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += words[j]
                strong = total >= (line_words if i == j else run_words)
                if words[i] and words[j] and (strong or i == j):
                    out.append((xxhash.xxh64_intdigest(raw[8 * i : 8 * j + 8]), i, j - i + 1, strong))
                    long.discard((i, j))
        a = b
    return out + [(xxhash.xxh64_intdigest(raw[8 * i : 8 * j + 8]), i, j - i + 1, True) for i, j in sorted(long)]


def text_hash(column: Column) -> Column:
    return F.xxhash64(F.coalesce(column, F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_hash(F.col("text")).alias("text_hash"))


def find_runs(docs: DataFrame, **how) -> DataFrame:
    """RUNS of all texts: slim rows without text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.pieces(whole):
                found = [runs(t, **how) for t in batch.column("text").to_pylist()]
                n = np.array([len(f) for f in found])
                flat = [x for f in found for x in f]
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array([x[0] for x in flat], np.uint64).view(np.int64)), batch.column("doc_id").take(at), batch.column("text_hash").take(at),
                        pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int32()),
                        pa.array([x[3] for x in flat], pa.bool_()),
                    ],
                    names=["hash", "doc_id", "text_hash", "start", "lines", "strong"],
                )

    return _keyed(docs).mapInArrow(tidied(run), RUNS)


def repeated_runs(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text_hash, start, lines): runs to remove.

    The slim rows tell which hashes repeat and where each run comes first. Lines of a text that come first in the same
    other text at the same offset form a run; it counts if a repeated run of a chunk lies in it, so that the ends of a
    passage that chunks cut off go with it. The bytes of such runs and of their first occurrences are brought together,
    and equal ones are removed."""
    found = find_runs(docs, **how)
    first = F.min(F.struct("doc_id", "start", "text_hash")).alias("first")
    repeated = found.groupBy("hash").agg(F.count("*").alias("n"), first).where("n > 1")
    repeated = repeated.select("hash", F.col("first.doc_id").alias("to_doc"), F.col("first.start").alias("to_start"), F.col("first.text_hash").alias("to_text"))
    later = found.join(repeated, "hash").where("doc_id <> to_doc or start <> to_start or text_hash <> to_text")
    pair = ["doc_id", "text_hash", "to_doc", "to_text", "shift"]
    lines = later.select(
        *pair[:-1], (F.col("to_start") - F.col("start")).alias("shift"), "strong", F.explode(F.sequence("start", F.col("start") + F.col("lines") - 1)).alias("line")
    )
    lines = lines.groupBy(*pair, "line").agg(F.max("strong").alias("strong"))
    island = lines.withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy(*pair).orderBy("line")))
    claims = island.groupBy(*pair, "island").agg(F.min("line").alias("start"), F.count("*").cast("int").alias("lines"), F.max("strong").alias("strong")).where("strong")
    claims = cut(claims.select("doc_id", "text_hash", "start", "lines", "to_doc", "to_text", (F.col("start") + F.col("shift")).alias("to_start")))
    firsts = claims.select(F.col("to_doc").alias("doc_id"), F.col("to_text").alias("text_hash"), F.col("to_start").alias("start"), "lines", "to_doc", "to_text", "to_start").distinct()
    wanted = claims.unionByName(firsts)
    # only the texts that have such runs are read again and dealt out, each once however often it is repeated
    named = _keyed(docs).join(sendable(wanted.select("doc_id", "text_hash").distinct()), ["doc_id", "text_hash"], "left_semi")
    split = named.select("doc_id", "text_hash", F.split("text", "\n", -1).alias("split")).dropDuplicates(["doc_id", "text_hash"])
    slices = F.array_join(F.slice("split", F.col("start") + 1, F.col("lines")), "\n")
    texts = split.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "start", "lines", "to_doc", "to_text", "to_start", slices.alias("content"))
    is_first = "doc_id = to_doc and text_hash = to_text and start = to_start"
    key = ["to_doc", "to_text", "to_start", "lines"]
    heads = texts.where(is_first).select(*key, F.col("content").alias("first_content")).dropDuplicates(key)
    same = texts.where(f"not ({is_first})").join(heads, key).where("content = first_content")
    return cut(same.select("doc_id", "text_hash", "start", "lines").distinct())


def dedupe(docs: DataFrame, **how) -> DataFrame:
    """docs with repeated passages taken out of `text`, and `lines_removed` (a column of that name is replaced).

    A passage stays in the document with the smallest doc_id. Rows with equal doc_id and text are treated alike. Rows
    with null doc_id or text are left as they are, with lines_removed 0; an empty text has nothing to remove. Texts that
    nothing is removed from are not shuffled."""
    docs = docs.drop("lines_removed")
    own = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])
    gone = repeated_runs(own, **how).groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).agg(F.collect_list(F.struct("start", "lines")).alias("_gone"))
    gone = cut(gone)
    keys = sendable(gone.select("_d", "_t"))
    same = (F.col("doc_id") == F.col("_d")) & (text_hash(F.col("text")) == F.col("_t"))
    whole = own.join(keys, same, "left_anti").withColumn("_removed", F.lit(0))
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.exists("_gone", lambda g: (i >= g["start"]) & (i < g["start"] + g["lines"])))
    cut_down = own.join(keys, same, "left_semi").join(gone, same).withColumn("_left", left)
    changed = cut_down.select(*[F.array_join("_left", "\n").alias("text") if c == "text" else F.col(c) for c in own.columns], (F.size(lines) - F.size("_left")).alias("_removed"))
    return whole.unionByName(changed).toDF(*docs.columns, "lines_removed")
