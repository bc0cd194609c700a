"""A training corpus from raw documents: quality, line dedup, near-dedup, decontamination, token ids.

Each stage takes what the one before kept, which `run` writes to the checkpoint folder and reads again, and all but the
last return the columns of documents, of whatever names. In all stages a null text counts as an empty one, rows that repeat
are treated alike, and an empty table gives an empty one; what else holds is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, decontam, linededup, neardup, quality, similar
from tideline.llm.queries import WORD_BPE, table
from tideline.llm.spark_io import cut


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers do not reject. Without labels of both kinds nothing is rejected."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once stay where they come first; a document left without any word goes. n_chars
    follows the text. Documents without doc_id or text stay as they are."""
    left = linededup.dedupe(docs)
    emptied = (F.col("lines_removed") > 0) & (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) == 0)
    changed = F.when(F.col("lines_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.where(~emptied).withColumn("n_chars", changed).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts linked by a similarity of 0.8 of their 5-word shingles, found by
    SimHash fingerprints and, where these differ in more bits, by minimum hashes. Texts without words are one group; of
    several rows of one doc_id one stays."""
    return neardup.keep_one(docs, similar.cluster, similar.marks)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; all of them where the benchmark is empty."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and their number, beside its columns."""
    return bpe.encode(docs, WORD_BPE)


STAGES = [
    ("quality", good),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("bpe", encoded),
]

#: Training and hashing stages have no SQL form; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; lineage is cut after each."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
