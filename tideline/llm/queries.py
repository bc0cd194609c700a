"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import balltree, bpe, chat, decontam, fim, langid, linededup, lm, neardup, quality, tokencount, toxicity, vectorcode
from tideline.llm import text as tx

#: The pattern that splits text before the merges of the rank files: a fixed value of those files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = quality.features(table(spark, sf_dir, "documents"))
    return quality.score_features(seen, quality.learn(seen, table(spark, sf_dir, "labels"))).select("doc_id", *quality.SCORES, "predicted")


def op2_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n", "similarity")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(tx.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score(docs, toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels")), held_out)


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(tx.remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    model, counts = lm.count(docs.where("doc_id is not null").where(~held_out))
    probed = lm.probe(docs, model, counts, held_out)
    return lm.score(probed, lm.fit(model, probed), counts)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(tx.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return langid.identify(docs, langid.train(docs.where(~held_out)), held_out)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedupe(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


PROBE = r"\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return chat.digest(chat.assemble(turns.unionByName(probe), BYTE_RANKS, PATTERN), BYTE_RANKS, PATTERN)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"))


def op11_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES).drop("text")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_vectorcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.digest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_balltree": op2_balltree,
        "op3_decontam": op3_decontam,
        "op4_toxicity": op4_toxicity,
        "op5_lm": op5_lm,
        "op6_langid": op6_langid,
        "op7_bpe": op7_bpe,
        "op8_chat": op8_chat,
        "op9_neardup": op9_neardup,
        "op10_linededup": op10_linededup,
        "op11_tokencount": op11_tokencount,
        "op12_fim": op12_fim,
        "op13_vectorcode": op13_vectorcode,
    }


OP2_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP3_SQL = """
WITH d AS (
  SELECT DISTINCT doc_id, text, [w FOR w IN string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') IF w <> ''] AS ws
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT DISTINCT item_id, [w FOR w IN string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') IF w <> ''] AS ws
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bs AS (
  SELECT item_id, ws, len(ws) AS n, least(len(ws), 5) AS k FROM b WHERE len(ws) > 0
), bp AS (
  SELECT item_id, n, k, i, array_to_string(ws[i + 1 : i + k], ' ') AS s FROM bs, range(0, n - k + 1) AS r(i)
), dp AS (
  SELECT doc_id, text, ks.k, i, len(ws) AS words, array_to_string(ws[i + 1 : i + ks.k], ' ') AS s
  FROM d, (SELECT DISTINCT k FROM bs) AS ks, range(0, len(ws) - ks.k + 1) AS r(i)
), win AS (
  SELECT DISTINCT doc_id, text, item_id, n, dp.k, words, least(greatest(dp.i - bp.i, 0), greatest(words - n, 0)) AS start
  FROM dp JOIN bp ON dp.s = bp.s AND dp.k = bp.k
), a AS (
  SELECT win.doc_id, win.text, win.item_id, win.start, win.n, win.words, dp.s, count(*) AS a
  FROM win JOIN dp ON win.doc_id IS NOT DISTINCT FROM dp.doc_id AND win.text = dp.text AND win.k = dp.k
    AND dp.i BETWEEN win.start AND win.start + win.n - win.k
  GROUP BY ALL
), bc AS (
  SELECT item_id, s, count(*) AS b FROM bp GROUP BY ALL
), shared AS (
  SELECT doc_id, text, a.item_id, start, n, words, sum(least(a, b)) AS common
  FROM a JOIN bc ON a.item_id = bc.item_id AND a.s = bc.s GROUP BY ALL
), alike AS (
  SELECT doc_id, text, item_id, start, n, common / (n + least(n, words) - 2 * least(n, 5) + 2 - common) AS similarity FROM shared
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY similarity DESC, start) AS r FROM alike WHERE similarity >= 0.8
)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS n, CAST(similarity AS DOUBLE) AS similarity FROM best WHERE r = 1
"""


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), r AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r
), p AS (
  SELECT *, array_to_string(u[1:i], '') AS prefix, array_to_string(u[i + 1:j], '') AS middle, array_to_string(u[j + 1:], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op13_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Every distance of every round, computed."""
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS id, vec_id, label, e, len(e) // {parts} AS w FROM (
    SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
), x AS MATERIALIZED (
  SELECT id, p, CAST(e[p * w + 1 : (p + 1) * w] AS DOUBLE[]) AS x FROM v, range(0, {parts}) AS r(p)
), c0 AS MATERIALIZED (SELECT p, id - 1 AS k, x AS c FROM x WHERE id <= {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT x.id, x.p, any_value(x.x) AS x, min(CAST(list_sum([(q[1] - q[2]) * (q[1] - q[2]) FOR q IN list_zip(x.x, c.c)]) AS HUGEINT) * {entries} + c.k) AS best
  FROM x JOIN c{n} AS c USING (p) GROUP BY x.id, x.p)""")
        if n < rounds:
            steps.append(f"""m{n} AS MATERIALIZED (
  SELECT p, k, list(CAST(f AS DOUBLE) ORDER BY i) AS c FROM (
    SELECT p, best % {entries} AS k, i, floor(sum(x[i]) / count(*)) AS f FROM a{n}, range(1, 1 + (SELECT max(w) FROM v)) AS r(i) GROUP BY ALL) GROUP BY ALL
), c{n + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.c, c.c) AS c FROM c{n} AS c LEFT JOIN m{n} AS m ON c.p = m.p AND c.k = m.k)""")
    joined = ",\n".join(steps)
    return f"""WITH {joined}, coded AS (
  SELECT id, string_agg(format('{{:02x}}', CAST(best % {entries} AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY id
), books AS (
  SELECT sha256(string_agg(array_to_string([CAST(CAST(f AS BIGINT) AS VARCHAR) FOR f IN c], ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (id), books"""


def oracles() -> dict[str, str]:
    return {"op2_balltree": OP2_SQL, "op3_decontam": OP3_SQL, "op12_fim": OP12_SQL, "op13_vectorcode": op13_sql()}
