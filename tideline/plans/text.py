"""Queries over activity records and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.session import table
from tideline.sources import activity, models

LINES, SAMPLED = 4, 5


def _records(spark, sf_dir):
    """events as records of an activity export."""
    n = F.col("event_id")
    title = F.when(n % 5 == 0, F.concat(F.lit("Searched for "), "props")).when(n % 5 == 1, F.concat(F.lit("Visited "), "event_type")).when(n % 5 == 2, F.concat(F.lit("Viewed "), "event_type")).when(n % 35 == 3, F.lit("")).otherwise(F.col("event_type"))
    url = F.when(
        n % 4 == 0,
        F.concat(F.lit("https://maps.example/?center="), (n % 90).cast("string"), F.lit(".5,-"), (n % 180).cast("string"), F.lit(".25&z=1"))
    ).when(n % 4 == 1, F.lit("https://example.org/"))
    ev = table(spark, sf_dir, "events")
    said = F.when(n % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    said = said.otherwise(F.concat(F.date_format(F.expr("ts - INTERVAL 210 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-03:30")))
    return ev.select("event_id", title.alias("title"), F.when(n % 50 != 7, said).alias("time"), F.array(F.struct(url.alias("url"))).alias("locationInfos"))


RECORDS = """r AS (
  SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'search' WHEN event_id % 5 = 1 THEN 'visit' WHEN event_id % 5 = 2 THEN 'view' ELSE 'other' END AS activity_type,
    CASE WHEN event_id % 5 = 0 THEN props ELSE event_type END AS content,
    CASE WHEN event_id % 4 = 0 THEN (event_id % 90)::VARCHAR || '.5,-' || (event_id % 180)::VARCHAR || '.25' END AS location,
    CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'
      WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00'
      ELSE strftime(ts - INTERVAL 210 MINUTE, '%Y-%m-%dT%H:%M:%S') || '-03:30' END AS said
  FROM events WHERE event_id % 50 <> 7 AND NOT (event_id % 5 NOT IN (0, 1, 2) AND event_id % 35 = 3)
)"""


def _render(spark, sf_dir):
    a = activity.parse(_records(spark, sf_dir))
    return a.select("event_id", activity.render(F.col("ts"), F.col("offset_minutes"), F.col("activity_type"), F.col("content"), F.col("location")).alias("line"))


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(activity.lines(F.col("text"))).alias("line_no", "line"))


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(activity.chunks(activity.lines(F.col("text")), LINES)).alias("chunk_id", "chunk"))


def _sample(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", activity.chunks(activity.lines(F.col("text")), 1).alias("c"))
    return made.select("doc_id", F.explode(activity.sample(F.col("c"), SAMPLED, F.col("doc_id"))).alias("chunk"))


def _fenced(spark, sf_dir):
    text = F.when(
        F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nend"))
    ).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```\n"), "props", F.lit("```"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(activity.json_text(text), "$.k").cast("bigint").alias("k"))


#: How an order's date is said, by o_orderkey modulo their number; day and month are ambiguous in the last four up to the 12th.
SAID = [
    "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'23:mm:ss'-05:00'",
    "yyyy/M/d", "dd-MM-yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "M/d/yyyy", "'some day'", "yyyy-'02-30'", "'  'yyyy-MM-dd'  '",
]


def _spelled(spark, sf_dir):
    raw = F.lit(None).cast("string")
    for k, f in enumerate(SAID):
        raw = F.when(F.col("o_orderkey") % len(SAID) == k, F.date_format("o_orderdate", f)).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", activity.spell_date(raw).alias("spelled"))


SAID_SQL = [
    "%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%g", "%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%dT23:%M:%S-05:00",
    "%Y/%-m/%-d", "%d-%m-%Y", "%d/%m/%Y", "%m-%d-%Y", "%-m/%-d/%Y", "some day", "some day", "  %Y-%m-%d  ",
]
#: DuckDB takes offsets into account and lets days run over; the rule reads the date as it is said, so offsets go first.
SPELLED_SQL = rf"""WITH s AS (
  SELECT o_orderkey, trim(CASE o_orderkey % {len(SAID)} {' '.join(f"WHEN {k} THEN strftime(o_orderdate, '{f}')" for k, f in enumerate(SAID_SQL))} END) AS said FROM orders
)
SELECT o_orderkey, strftime(try_strptime(regexp_replace(said, '(T.*)[+-]\d\d:?\d\d$', '\1'), {activity.DATE_FORMATS}), '%A, %B %d, %Y') AS spelled FROM s"""

def _completions(spark, sf_dir):
    """events as what an extractor says of chunks: one value each, fenced or not, some of them of the wrong kind or unknown."""
    n = F.col("event_id")
    value = F.when(n % 7 == 0, F.lit('"many"')).when(n % 7 == 1, F.lit("null")).when(n % 7 == 2, F.lit("2.5")).otherwise((n % 100).cast("string"))
    item = F.concat(F.lit('{"indicator": "'), F.when(n % 11 == 0, "ghost").otherwise(F.col("event_type")), F.lit('", "value": '), value, F.lit("}"))
    body = F.when(n % 13 == 0, F.lit('{"other": []}')).otherwise(F.concat(F.lit('{"extractions": ['), item, F.lit("]}")))
    text = F.when(n % 17 == 0, F.lit("I found nothing.")).when(n % 2 == 0, F.concat(F.lit("Found:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return table(spark, sf_dir, "events").select(n.alias("chunk_id"), text.alias("completion"))


COUNTED = [("click", "count"), ("error", "continuous"), ("purchase", "ordinal"), ("signup", "categorical"), ("view", "count")]
EXTRACTED_SQL = """e AS (SELECT event_id AS chunk_id, CASE WHEN event_id % 11 = 0 THEN 'ghost' ELSE event_type END AS indicator, event_type,
    CASE event_id % 7 WHEN 0 THEN 'many' WHEN 1 THEN NULL WHEN 2 THEN '2.5' ELSE CAST(event_id % 100 AS VARCHAR) END AS value, event_id % 7 AS k FROM events),
f AS (SELECT *, CASE WHEN chunk_id % 17 = 0 THEN 'no JSON' WHEN chunk_id % 13 = 0 THEN 'no list of extractions' WHEN indicator = 'ghost' THEN 'ghost: unknown indicator'
    WHEN k <> 1 AND (indicator IN ('click', 'view') AND k IN (0, 2) OR indicator = 'error' AND k = 0 OR indicator = 'signup' AND k <> 0) THEN indicator || ': value does not fit the dtype' END AS fault FROM e)"""


def _extracted(spark, sf_dir, part):
    measured = spark.createDataFrame(COUNTED, "name string, dtype string")
    return models.observed(models.extractions(_completions(spark, sf_dir)), measured)[part]


LINES_SQL = r"l AS (SELECT doc_id, [x FOR x IN [regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN string_split(text, chr(10))] IF x <> ''] AS ls FROM documents)"

QUERIES = {
    "activity_classify": lambda spark, d: activity.parse(_records(spark, d)).groupBy("activity_type").agg(F.count("*").alias("n"), F.countDistinct("content").alias("contents")),
    "location_extract": lambda spark, d: activity.parse(_records(spark, d)).where("location is not null").select("event_id", "location"),
    "render_lines": _render,
    "doc_lines": _lines,
    "doc_chunks": _chunks,
    "chunk_sample": _sample,
    "props_json": lambda spark, d: table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")),
    "json_from_text": _fenced,
    "date_spell_out": _spelled,
    "extraction_rows": lambda s, d: _extracted(s, d, 0).select("ingest_seq", "indicator", "value"),
    "extraction_faults": lambda s, d: _extracted(s, d, 1),
}

ORACLES = {
    "activity_classify": f"WITH {RECORDS} SELECT activity_type, count(*) AS n, count(DISTINCT content) AS contents FROM r GROUP BY 1",
    "location_extract": f"WITH {RECORDS} SELECT event_id, location FROM r WHERE location IS NOT NULL",
    "render_lines": f"WITH {RECORDS} SELECT event_id, '[' || said || ']' || coalesce(' @ ' || location, '') || ' [' || activity_type || '] ' || content AS line FROM r",
    "doc_lines": f"WITH {LINES_SQL} SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, ls[i] AS line FROM l, range(1, len(ls) + 1) AS t(i)",
    "doc_chunks": f"WITH {LINES_SQL} SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, array_to_string(ls[i * {LINES} + 1 : (i + 1) * {LINES}], chr(10)) AS chunk FROM l, range(0, CAST(ceil(len(ls) / {LINES}) AS BIGINT)) AS t(i)",
    "props_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "json_from_text": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "date_spell_out": SPELLED_SQL,
    "extraction_rows": f"WITH {EXTRACTED_SQL} SELECT chunk_id AS ingest_seq, indicator, value FROM f WHERE fault IS NULL",
    "extraction_faults": f"WITH {EXTRACTED_SQL} SELECT chunk_id, fault FROM f WHERE fault IS NOT NULL",
}
