"""Queries over observations: 24 aggregations, grains, encoders, ingest and reshape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.aggregates import REGISTRY
from tideline.operators import observations as ob
from tideline.operators import reshape
from tideline.session import table
from tideline.sources import models
from tideline.sources.adapters import EVENT_TYPES, OBS_SQL, SHIP_SQL, observations, shipments

#: Decimal places kept of numbers that have few of their own.
PLACES, MEAN_PLACES = 6, 9

PARSED = "p AS (SELECT indicator, TRY_CAST(value AS DOUBLE) AS v, TRY_CAST(timestamp AS TIMESTAMP) AS ts, ingest_seq AS seq FROM obs WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL AND TRY_CAST(timestamp AS TIMESTAMP) IS NOT NULL)"


def windows(grain: str) -> str:
    return f"""b AS (SELECT *, CAST(date_trunc('{grain}', ts) AS TIMESTAMP) AS time_bucket FROM p), w AS (
  SELECT *, row_number() OVER (PARTITION BY indicator, time_bucket ORDER BY v) - 1 AS rk, count(*) OVER (PARTITION BY indicator, time_bucket) AS n,
    lag(v) OVER (PARTITION BY indicator, time_bucket ORDER BY ts, seq) AS before, row_number() OVER (PARTITION BY indicator, time_bucket ORDER BY ts, seq) - 1 AS pos,
    sum(v) OVER (PARTITION BY indicator, time_bucket) AS total, avg(v) OVER (PARTITION BY indicator, time_bucket) AS mid
  FROM b
)"""


def nearest(q: float) -> str:
    return f"max(v) FILTER (WHERE rk = round((n - 1) * {q}::DOUBLE))"


AGG_SQL = {
    "mean": "avg(v)", "sum": "sum(v)", "min": "min(v)", "max": "max(v)", "std": "stddev_samp(v)", "var": "var_samp(v)",
    "last": "arg_max(v, (ts, seq))", "first": "arg_min(v, (ts, seq))", "count": "count(v)::DOUBLE", "median": "median(v)", "n_unique": "count(DISTINCT v)::DOUBLE",
    "skew": "CASE WHEN var_pop(v) > 0 THEN avg(pow(v - mid, 3)) / pow(avg(pow(v - mid, 2)), 1.5) END",
    "kurtosis": "CASE WHEN var_pop(v) > 0 THEN avg(pow(v - mid, 4)) / pow(avg(pow(v - mid, 2)), 2) - 3 END",
    "entropy": "CASE WHEN min(v) >= 0 THEN sum(CASE WHEN v > 0 THEN -v / total * ln(v / total) WHEN total <> 0 THEN 0 END) END",
    **{name: nearest(q) for name, q in (("p10", 0.1), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9), ("p99", 0.99))},
    "range": "max(v) - min(v)", "iqr": f"{nearest(0.75)} - {nearest(0.25)}", "cv": "CASE WHEN abs(avg(v)) > 1e-15 THEN stddev_samp(v) / avg(v) END",
    "instability": "avg(pow(v - before, 2))", "trend": "CASE WHEN count(*) < 2 THEN 0.0 ELSE covar_pop(v, pos) / nullif(var_pop(pos), 0) END",
}


def tidy(df: DataFrame) -> DataFrame:
    """Statistics to single precision: both engines add up in an order of their own, which shows in the last digits of a
    double. Few decimal places would not do: variances of values with two places lie on exact halves too often. What is left
    of moments that are zero goes with the places after MEAN_PLACES."""
    return df.withColumn("value", (F.round("value", MEAN_PLACES) + F.lit(0.0)).cast("float").cast("double"))


def single(sql: str) -> str:
    return f"CAST(CAST(round({sql}, {MEAN_PLACES}) + 0.0 AS FLOAT) AS DOUBLE)"


def _agg(name: str):
    def query(spark, sf_dir):
        dims = ob.indicators(spark, [{"indicator": i, "granularity": "daily", "aggregation": name} for i in EVENT_TYPES])
        return tidy(ob.aggregate(observations(spark, sf_dir), dims, [name]).select("indicator", "time_bucket", "value"))

    return query


def _agg_sql(name: str, grain: str = "day", source: str = OBS_SQL) -> str:
    return f"WITH {source}, {PARSED}, {windows(grain)} SELECT indicator, time_bucket, {single(AGG_SQL[name])} AS value FROM w GROUP BY indicator, time_bucket"


SHIPPED = ["qty_A", "qty_N", "qty_R", "disc_A", "disc_N", "disc_R"]


def _grain(grain: str, name: str = "mean"):
    def query(spark, sf_dir):
        dims = ob.indicators(spark, [{"indicator": i, "granularity": grain, "aggregation": name} for i in SHIPPED])
        return tidy(ob.aggregate(shipments(spark, sf_dir), dims, [name]).select("indicator", "time_bucket", "value"))

    return query


def _finest(spark, sf_dir):
    dims = ob.indicators(spark, [{"indicator": i} for i in EVENT_TYPES])
    twice = ob.union([observations(spark, sf_dir), None, observations(spark, sf_dir)], spark)
    return ob.finest(twice, dims).select("indicator", "time_bucket", "value")


MIXED = [("click", "hourly", "mean"), ("error", "daily", "sum"), ("purchase", "weekly", "p90"), ("signup", "monthly", "instability"), ("view", "finest", "mean")]


def _mixed(spark, sf_dir):
    dims = ob.indicators(spark, [dict(zip(("indicator", "granularity", "aggregation"), m)) for m in MIXED])
    return tidy(ob.flatten(observations(spark, sf_dir), dims, sorted({m[2] for m in MIXED})))


def _mixed_sql(single=single) -> str:
    parts = []
    for i, grain, name in MIXED:
        if grain == "finest":
            parts.append(f"SELECT DISTINCT indicator, 'finest' AS granularity, ts AS time_bucket, {single("v")} AS value FROM p WHERE indicator = '{i}'")
        else:
            w = windows(ob.TRUNC[grain])
            parts.append(f"SELECT indicator, '{grain}', time_bucket, {single(AGG_SQL[name])} FROM (WITH {w} SELECT * FROM w WHERE indicator = '{i}') GROUP BY indicator, time_bucket")
    return f"WITH {OBS_SQL}, {PARSED} " + " UNION ALL ".join(reversed(parts))


def _overview(spark, sf_dir):
    dims = ob.indicators(spark, [dict(zip(("indicator", "granularity", "aggregation"), m)) for m in MIXED])
    out = models.overview(ob.flatten(observations(spark, sf_dir), dims, sorted({m[2] for m in MIXED})))
    return out.withColumns({c: F.col(c).cast("float").cast("double") for c in ("mean", "std")})


def _workers(spark, sf_dir):
    obs = observations(spark, sf_dir)
    dims = ob.indicators(spark, [{"indicator": i, "granularity": "daily", "aggregation": "count"} for i in EVENT_TYPES])
    return ob.aggregate(
        ob.union([obs.where("ingest_seq % 2 = 0"), None, obs.where("ingest_seq % 2 = 1"), obs.where("ingest_seq % 10 = 0")], spark), dims, ["count"]
    ).select("indicator", "time_bucket", "value")


def _known(spark, sf_dir):
    dims = ob.indicators(spark, [{"indicator": "click"}, {"indicator": "view"}, {"indicator": "absent"}])
    obs = observations(spark, sf_dir)
    return obs.join(dims.select("indicator"), "indicator", "left_semi").groupBy("indicator").agg(F.count("*").alias("n"))


def _lenient(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return obs.select("ingest_seq", F.round(ob.to_number(F.col("value")), PLACES).alias("number"), ob.to_time(F.col("timestamp")).alias("time"))


def _drop(spark, sf_dir):
    dims = ob.indicators(spark, [{"indicator": i} for i in EVENT_TYPES])
    return ob.parsed(observations(spark, sf_dir), dims).groupBy("indicator").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _orders(spark, sf_dir, dtype, column, levels=None):
    raw = table(spark, sf_dir, "orders").select(
        F.lit("x").alias("indicator"), F.col(column).cast("string").alias("value"), F.col("o_orderdate").cast("string").alias("timestamp"),
        F.col("o_orderkey").alias("ingest_seq")
    )
    dims = ob.indicators(spark, [{"indicator": "x", "dtype": dtype, "levels": levels}])
    return ob.encode(raw, dims).select(F.col("ingest_seq").alias("o_orderkey"), F.col("v").alias("code"))


LEVELS = ["5-low", " 4-NOT SPECIFIED", "3-Medium", "2-high ", "1-URGENT"]
LEVEL_SQL = "CASE lower(trim(o_orderpriority)) " + " ".join(f"WHEN '{x.strip().lower()}' THEN {i}.0" for i, x in enumerate(LEVELS)) + " END"


def _binary(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    raw = labels.select(
        "doc_id",
        F.when(F.col("doc_id") % 4 == 0, F.when(F.col("toxic") == 1, "YES").otherwise("No")).when(F.col("doc_id") % 4 == 1, F.col("toxic").cast("double").cast("string")).when(F.col("doc_id") % 4 == 2, F.col("toxic").cast("string")).otherwise("maybe").alias("value")
    )
    return raw.select("doc_id", ob.encode_binary(F.col("value")).alias("code"))


def _daily_mean(spark, sf_dir):
    dims = ob.indicators(spark, [{"indicator": i, "granularity": "daily", "aggregation": "mean"} for i in EVENT_TYPES])
    return ob.aggregate(observations(spark, sf_dir), dims, ["mean"])


def _pivot(spark, sf_dir):
    wide = reshape.pivot(_daily_mean(spark, sf_dir), EVENT_TYPES)
    return wide.select("time", *[F.round(c, MEAN_PLACES).alias(c) for c in EVENT_TYPES])


def _days(spark, sf_dir):
    return reshape.fractional_days(reshape.pivot(_daily_mean(spark, sf_dir), EVENT_TYPES)).select(F.round("time", PLACES).alias("time"), *[F.round(c, MEAN_PLACES).alias(c) for c in EVENT_TYPES])


def _dt(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", (reshape.micros(F.col("ts")) / 86400e6).alias("day"))
    return reshape.intervals(ev.groupBy("user_id", "day").agg(F.min("event_id").alias("event_id")), ["user_id"], "day").select("user_id", "event_id", F.round("dt", PLACES).alias("dt"))


def _from_events(spark, sf_dir):
    return observations(spark, sf_dir).select("indicator", F.round(ob.to_number(F.col("value")), PLACES).alias("value"), "timestamp", "ingest_seq").where("timestamp = 'bad time' or value is null")


PIVOT_SQL = ", ".join(f"round(avg(v) FILTER (WHERE indicator = '{c}'), {MEAN_PLACES}) AS {c}" for c in EVENT_TYPES)
#: The pivot averages the groups' means, of which there is one for each cell.
WIDE_SQL = f"WITH {OBS_SQL}, {PARSED}, wide AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time, {PIVOT_SQL} FROM p GROUP BY 1)"

QUERIES = {f"agg_{name}": _agg(name) for name in REGISTRY} | {
    **{f"bucket_{grain}": _grain(grain) for grain in ob.HOURS},
    "finest_dedup": _finest,
    "mixed_grain_flatten": _mixed,
    "data_overview": _overview,
    "obs_from_events": _from_events,
    "obs_union_workers": _workers,
    "obs_known_filter": _known,
    "obs_drop_nulls": _drop,
    "cast_lenient": _lenient,
    "encode_binary": _binary,
    "encode_ordinal": lambda spark, d: _orders(spark, d, "ordinal", "o_orderpriority", LEVELS),
    "encode_categorical": lambda spark, d: _orders(spark, d, "categorical", "o_orderstatus"),
    "pivot_wide": _pivot,
    "pivot_fractional_days": _days,
    "dt_intervals": _dt,
}

ORACLES = {f"agg_{name}": _agg_sql(name) for name in REGISTRY} | {
    **{f"bucket_{grain}": _agg_sql("mean", ob.TRUNC[grain], SHIP_SQL) for grain in ob.HOURS},
    "finest_dedup": f"WITH {OBS_SQL}, {PARSED} SELECT DISTINCT indicator, ts AS time_bucket, v AS value FROM p",
    "mixed_grain_flatten": _mixed_sql(),
    "data_overview": f"""WITH m AS ({_mixed_sql(lambda sql: sql)}), s AS (SELECT granularity, count(DISTINCT time_bucket) AS times, count(DISTINCT indicator) AS indicators FROM m GROUP BY 1)
SELECT granularity, times, indicators, indicator, {single('avg(value)')} AS mean, {single('stddev_samp(value)')} AS std FROM m JOIN s USING (granularity) GROUP BY ALL""",
    "obs_from_events": f"WITH {OBS_SQL} SELECT indicator, round(TRY_CAST(value AS DOUBLE), {PLACES}) AS value, timestamp, ingest_seq FROM obs WHERE timestamp = 'bad time' OR TRY_CAST(value AS DOUBLE) IS NULL",
    "obs_union_workers": f"WITH {OBS_SQL}, {PARSED} SELECT indicator, CAST(date_trunc('day', ts) AS TIMESTAMP) AS time_bucket, sum(CASE WHEN seq % 10 = 0 THEN 2 ELSE 1 END)::DOUBLE AS value FROM p GROUP BY 1, 2",
    "obs_known_filter": f"WITH {OBS_SQL} SELECT indicator, count(*) AS n FROM obs WHERE indicator IN ('click', 'view', 'absent') GROUP BY 1",
    "obs_drop_nulls": f"WITH {OBS_SQL}, {PARSED} SELECT indicator, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY 1",
    "cast_lenient": f"WITH {OBS_SQL} SELECT ingest_seq, round(TRY_CAST(value AS DOUBLE), {PLACES}) AS number, TRY_CAST(timestamp AS TIMESTAMP) AS time FROM obs",
    "encode_binary": "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE CAST(toxic AS DOUBLE) END AS code FROM labels",
    "encode_ordinal": f"SELECT o_orderkey, CAST({LEVEL_SQL} AS DOUBLE) AS code FROM orders",
    "encode_categorical": "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS code FROM orders",
    "pivot_wide": f"{WIDE_SQL} SELECT * FROM wide",
    "pivot_fractional_days": f"{WIDE_SQL} SELECT round(floor(epoch(time - (SELECT min(time) FROM wide))) / 86400.0, {PLACES})::DOUBLE AS time, {', '.join(EVENT_TYPES)} FROM wide",
    "dt_intervals": f"WITH d AS (SELECT user_id, epoch_us(ts) / 86400e6 AS day, min(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT user_id, event_id, round(coalesce(day - lag(day) OVER (PARTITION BY user_id ORDER BY day), 1e-6), {PLACES})::DOUBLE AS dt FROM d",
}
