"""Queries of the data-quality rules, over events with one indicator for each kind of dirt."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import observations as ob
from tideline.operators.quality_rules import Report
from tideline.session import table
from tideline.sources.adapters import OBS_SQL, observations

#: Observations that break every rule; the same text runs on both engines.
DIRTY = """
  SELECT event_type AS indicator, CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST(value AS STRING) END AS value,
    CASE WHEN event_id % 89 = 0 THEN 'bad time' ELSE CAST(ts AS STRING) END AS timestamp, event_id AS ingest_seq FROM {events}
  UNION ALL SELECT 'constant', '5.0', CAST(ts AS STRING), event_id FROM {events} WHERE event_id % 50 = 0
  UNION ALL SELECT 'few', CAST(event_id AS STRING), CAST(ts AS STRING), event_id FROM {events} WHERE event_id IN (3, 300, 700)
  UNION ALL SELECT 'words', CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'medium' END, CAST(ts AS STRING), event_id FROM {events} WHERE event_id % 60 = 0
  UNION ALL SELECT 'half_timed', CAST(value AS STRING), CASE WHEN event_id % 5 < 3 THEN 'x' ELSE CAST(ts AS STRING) END, event_id FROM {events} WHERE event_id % 7 = 0
  UNION ALL SELECT 'never_timed', CAST(value AS STRING), 'x', event_id FROM {events} WHERE event_id % 70 = 0
  UNION ALL SELECT 'flag', CAST(event_id % 3 AS STRING), CAST(ts AS STRING), event_id FROM {events} WHERE event_id % 11 = 0
  UNION ALL SELECT 'tally', CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 7 - 2 AS STRING) ELSE '0.5' END, CAST(ts AS STRING), event_id FROM {events} WHERE event_id % 13 = 0
  UNION ALL SELECT 'spiky', CASE WHEN event_id % 500 = 0 THEN '1000000.0' ELSE CAST(value AS STRING) END, CAST(ts AS STRING), event_id FROM {events} WHERE event_id % 10 = 0
  UNION ALL SELECT 'short', CAST(value AS STRING), CAST(ts AS STRING), event_id FROM {events} WHERE day(ts) <= 2 AND event_id % 3 = 0
  UNION ALL SELECT 'gappy', CAST(value AS STRING), CAST(ts AS STRING), event_id FROM {events} WHERE (day(ts) <= 3 OR day(ts) >= 25) AND event_id % 4 = 0
  UNION ALL SELECT 'stuck', CASE WHEN event_id % 10 < 7 THEN '7.0' ELSE CAST(value AS STRING) END, CAST(ts AS STRING), event_id FROM {events} WHERE event_id % 3 = 1
  UNION ALL SELECT 'ladder', CAST(event_id * 2 AS STRING), CAST(ts AS STRING), event_id FROM {events} WHERE event_id <= 40
  UNION ALL SELECT 'up', CAST(day(ts) AS STRING), CAST(ts AS STRING), event_id FROM {events} WHERE event_id % 17 = 0
  UNION ALL SELECT 'down', CAST(100 - day(ts) AS STRING), CAST(ts AS STRING), event_id FROM {events} WHERE event_id % 19 = 0
"""

#: indicator, construct, dtype, granularity.
DIMS = [
    ("click", "use", "continuous", "daily"), ("view", "use", "continuous", "daily"), ("error", "harm", "continuous", "daily"), ("purchase", "trade", None, "daily"), ("signup", "trade", "continuous", None),
    ("constant", "c1", "continuous", "daily"), ("few", "c2", "continuous", "hourly"), ("words", "c3", "categorical", "daily"), ("half_timed", "c4", "continuous", "daily"), ("never_timed", "c5", "continuous", "daily"),
    ("flag", "c6", "binary", "daily"), ("tally", "c7", "count", "daily"), ("spiky", "c8", "continuous", "daily"), ("short", "c9", "continuous", "daily"), ("gappy", "c10", "continuous", "daily"),
    ("stuck", "c11", "continuous", "daily"), ("ladder", "c12", "continuous", "daily"), ("up", "trend", "continuous", "daily"), ("down", "trend", "continuous", "daily"), ("absent", "c13", "continuous", "daily"),
]


def report(spark, sf_dir) -> Report:
    obs = spark.sql(DIRTY, events=table(spark, sf_dir, "events"))
    return Report(obs, spark.createDataFrame(DIMS, "indicator string, construct string, dtype string, granularity string"))


def _rounded(df):
    return df.withColumn("metric", F.round("metric", 5))


def _sql(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


DIMS_SQL = ", ".join(f"({', '.join(map(_sql, d))})" for d in DIMS)
HOURS_SQL = "CASE granularity " + " ".join(f"WHEN '{k}' THEN {h}" for k, h in ob.HOURS.items()) + " END"

BASE = f"""WITH obs AS ({DIRTY.replace("{events}", "events")}), dims(indicator, construct, dtype, granularity) AS (VALUES {DIMS_SQL}),
r AS (SELECT *, TRY_CAST(value AS DOUBLE) AS v, TRY_CAST(timestamp AS TIMESTAMP) AS ts, {HOURS_SQL} AS hours FROM obs JOIN dims USING (indicator)),
p AS (SELECT indicator, dtype, any_value(hours) AS hours, count(*) AS rows, count(v) AS n, min(v) AS low, max(v) AS high, count(ts) AS timed, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM r GROUP BY 1, 2),
j AS (SELECT * FROM p WHERE n > 0),
q AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY indicator) AS n,
  v - lag(v) OVER (PARTITION BY indicator ORDER BY v) AS step FROM r WHERE v IS NOT NULL),
t AS (SELECT indicator, hours, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY indicator ORDER BY ts)) / 3.6e9 AS step FROM r WHERE ts IS NOT NULL AND indicator IN (SELECT indicator FROM j)),
quart AS (SELECT indicator, max(v) FILTER (WHERE k = round((n - 1) * 0.25)) AS q1, max(v) FILTER (WHERE k = round((n - 1) * 0.75)) AS q3, count(*) AS n FROM q WHERE dtype = 'continuous' GROUP BY 1),
day AS (SELECT construct, indicator, date_trunc('day', ts) AS d, avg(v) AS v FROM r WHERE v IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)
"""


def _select(rule: str, kind: str, severity: str, metric: str, rest: str, name: str = "indicator") -> str:
    return f"SELECT {name} AS indicator, '{rule}' AS rule, '{kind}' AS issue_type, {severity} AS severity, round(CAST({metric} AS DOUBLE), 5) AS metric {rest}"


RULES = {
    "missing": _select("V2", "missing", "'warning'", "0", "FROM dims WHERE indicator NOT IN (SELECT indicator FROM obs)"),
    "no_numeric": _select("V3", "no_numeric", "'error'", "rows", "FROM p WHERE n = 0"),
    "low_n": _select("V4", "low_n", "'warning'", "n", "FROM j WHERE n < 10"),
    "no_variance": _select("V5", "no_variance", "'error'", "low", "FROM j WHERE n > 1 AND low = high"),
    "bad_times": _select("V6-V7", "unparseable_timestamps", "CASE WHEN timed = 0 THEN 'error' ELSE 'warning' END", "(rows - timed) / rows", "FROM j WHERE (rows - timed) / rows > 0.5"),
    "dtype": " UNION ALL ".join(
        _select(rule, "dtype_violation", "'error'", "count(*)", f"FROM r WHERE dtype = '{dtype}' AND {bad} GROUP BY indicator")
        for rule, dtype, bad in (("V8", "binary", "v NOT IN (0, 1)"), ("V9", "count", "v < 0"), ("V10", "count", "v % 1 <> 0"))
    ),
    "outliers": _select(
        "V11", "dtype_violation", "'warning'", "count(*)",
        "FROM r JOIN quart USING (indicator) WHERE n >= 10 AND q3 > q1 AND (v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) GROUP BY indicator"
    ),
    "coverage": _select("V12", "insufficient_coverage", "'warning'", "span / 3.6e9", "FROM j WHERE timed >= 2 AND span / 3.6e9 < 10 * hours"),
    "gaps": _select("V13", "large_timestamp_gap", "'warning'", "max(step)", "FROM t GROUP BY indicator HAVING count(*) >= 3 AND max(step) > 5 * any_value(hours)"),
    "duplicates": _select(
        "V14", "suspicious_pattern", "'warning'", "max(k) / sum(k)",
        "FROM (SELECT indicator, v, count(*) AS k FROM r WHERE v IS NOT NULL AND coalesce(dtype, 'continuous') NOT IN ('binary', 'count') GROUP BY ALL) GROUP BY indicator HAVING sum(k) >= 2 AND count(*) > 1 AND max(k) / sum(k) > 0.5"
    ),
    "arithmetic": _select("V15", "suspicious_pattern", "'warning'", "min(step)", "FROM q GROUP BY indicator HAVING count(*) >= 5 AND count(DISTINCT step) = 1 AND min(step) <> 0"),
    "construct_correlation": _select(
        "V16", "low_construct_correlation", "'warning'", "corr(a.v, b.v)",
        "FROM day a JOIN day b ON a.construct = b.construct AND a.d = b.d AND a.indicator < b.indicator GROUP BY a.construct, a.indicator, b.indicator HAVING count(*) >= 10 AND corr(a.v, b.v) < 0",
        "a.construct"
    ),
}

QUERIES = {f"rule_{name}": (lambda spark, d, name=name: _rounded(getattr(report(spark, d), name)())) for name in RULES} | {
    "rule_no_data": lambda spark, d: _rounded(Report(observations(spark, d).where("false"), report(spark, d).dims).no_data()),
    "quality_issues": lambda spark, d: _rounded(report(spark, d).issues()),
    "quality_report": lambda spark, d: report(spark, d).verdict(),
    "indicator_profile": lambda spark, d: ob.profile(observations(spark, d)).select("indicator", "rows", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")]),
    "data_summary": lambda spark, d: ob.profile(observations(spark, d)).select(
        "indicator",
        F.format_string(
            "n=%d, mean=%s, std=%s", "n", F.coalesce(F.round("mean", 2).cast("decimal(20,2)").cast("string"), F.lit("N/A")),
            F.coalesce(F.round("std", 2).cast("decimal(20,2)").cast("string"), F.lit("N/A"))
        ).alias("summary")
    ),
    "indicator_count": lambda spark, d: observations(spark, d).agg(F.countDistinct("indicator").alias("indicators")),
    "value_mode": lambda spark, d: observations(spark, d).where("value is not null").groupBy("indicator", "value").agg(F.count("*").alias("k")).groupBy("indicator").agg(F.max("k").alias("most"), F.round(F.max("k") / F.sum("k"), 9).alias("share")),
}

_ALL = " UNION ALL ".join(RULES.values())
ORACLES = {f"rule_{name}": BASE + sql for name, sql in RULES.items()} | {
    "rule_no_data": "SELECT 'all' AS indicator, 'V1' AS rule, 'no_data' AS issue_type, 'error' AS severity, CAST(0 AS DOUBLE) AS metric",
    "quality_issues": BASE + _ALL,
    "quality_report": BASE + f"SELECT count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM ({_ALL})",
    "indicator_profile": f"WITH {OBS_SQL}, x AS (SELECT *, TRY_CAST(value AS DOUBLE) AS v FROM obs) SELECT indicator, count(*) AS rows, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high FROM x GROUP BY 1",
    "data_summary": f"WITH {OBS_SQL}, x AS (SELECT *, TRY_CAST(value AS DOUBLE) AS v FROM obs) SELECT indicator, 'n=' || count(v) || ', mean=' || coalesce(CAST(CAST(round(avg(v), 2) AS DECIMAL(20,2)) AS VARCHAR), 'N/A') || ', std=' || coalesce(CAST(CAST(round(stddev_samp(v), 2) AS DECIMAL(20,2)) AS VARCHAR), 'N/A') AS summary FROM x GROUP BY 1",
    "indicator_count": f"WITH {OBS_SQL} SELECT count(DISTINCT indicator) AS indicators FROM obs",
    "value_mode": f"WITH {OBS_SQL}, c AS (SELECT indicator, value, count(*) AS k FROM obs WHERE value IS NOT NULL GROUP BY ALL) SELECT indicator, max(k) AS most, round(max(k) / sum(k), 9) AS share FROM c GROUP BY 1",
}
