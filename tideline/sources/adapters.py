"""The test tables as the inputs of the operators, with the dirt that the validators look for put in by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import table

#: The same observations in SQL, for the oracles.
OBS_SQL = """obs AS (
  SELECT event_type AS indicator,
    CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value,
    CASE WHEN event_id % 89 = 0 THEN 'bad time' ELSE CAST(ts AS VARCHAR) END AS timestamp,
    event_id AS ingest_seq
  FROM events
)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw observations: some values null or not numeric, some times not parseable."""
    n = F.col("event_id")
    value = F.when(n % 101 == 0, None).when(n % 97 == 0, "n/a").otherwise(F.col("value").cast("string"))
    time = F.when(n % 89 == 0, "bad time").otherwise(F.col("ts").cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("indicator"), value.alias("value"), time.alias("timestamp"), n.alias("ingest_seq"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as observations over several years: quantity and discount by return flag."""
    li = table(spark, sf_dir, "lineitem")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    part = lambda kind, column: li.select(
        F.concat(F.lit(kind), F.col("l_returnflag")).alias("indicator"), F.col(column).cast("string").alias("value"),
        F.col("l_shipdate").cast("string").alias("timestamp"), seq.alias("ingest_seq")
    )
    return part("qty_", "l_quantity").unionByName(part("disc_", "l_discount"))


SHIP_SQL = """obs AS (
  SELECT 'qty_' || l_returnflag AS indicator, CAST(l_quantity AS VARCHAR) AS value, CAST(l_shipdate AS VARCHAR) AS timestamp, l_orderkey * 10 + l_linenumber AS ingest_seq FROM lineitem
  UNION ALL
  SELECT 'disc_' || l_returnflag, CAST(l_discount AS VARCHAR), CAST(l_shipdate AS VARCHAR), l_orderkey * 10 + l_linenumber FROM lineitem
)"""

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as posterior draws of a stable two-variable system: a (row by row), c."""
    e = lambda k: F.element_at("embedding", k).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("draw"), (-1 - F.abs(e(1))).alias("a11"), e(2).alias("a12"), e(3).alias("a21"), (-1 - F.abs(e(4))).alias("a22"), e(5).alias("c1"), e(6).alias("c2"), e(7).alias("lp")
    )


DRAWS_SQL = """draws AS (
  SELECT vec_id AS draw, -1 - abs(CAST(embedding[1] AS DOUBLE)) AS a11, CAST(embedding[2] AS DOUBLE) AS a12, CAST(embedding[3] AS DOUBLE) AS a21,
    -1 - abs(CAST(embedding[4] AS DOUBLE)) AS a22, CAST(embedding[5] AS DOUBLE) AS c1, CAST(embedding[6] AS DOUBLE) AS c2, CAST(embedding[7] AS DOUBLE) AS lp
  FROM embeddings
)"""
