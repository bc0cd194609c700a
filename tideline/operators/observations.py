"""Long observations: encode, parse, bucket by calendar grain, aggregate, dedupe and flatten.

Raw observations are (indicator, value, timestamp) strings with ingest_seq, which breaks ties in time. What an indicator
means (dtype, granularity, aggregation, ordinal levels) is a dimension table that is joined to them; it has a row for each
indicator, so Spark broadcasts it by its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import aggregates

#: Granularities with their hours; "finest" keeps single observations.
HOURS = {"hourly": 1, "daily": 24, "weekly": 168, "monthly": 720, "yearly": 8760}
TRUNC = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}

#: Labels of binary indicators: fixed values.
TRUE_LABELS = ["true", "yes", "1", "1.0", "t", "y"]
FALSE_LABELS = ["false", "no", "0", "0.0", "f", "n"]

RAW = "indicator string, value string, timestamp string, ingest_seq bigint"


def union(frames: list[DataFrame], spark: SparkSession) -> DataFrame:
    """All workers' rows; rows that occur in several stay. Missing frames are skipped."""
    held = [f.select("indicator", "value", "timestamp", "ingest_seq") for f in frames if f is not None]
    return reduce(DataFrame.unionByName, held) if held else spark.createDataFrame([], RAW)


def indicators(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Dimension table with its defaults: granularity finest, dtype continuous, aggregation mean."""
    fields = "indicator string, dtype string, granularity string, aggregation string, levels array<string>"
    made = [(r["indicator"], r.get("dtype") or "continuous", r.get("granularity") or "finest", r.get("aggregation") or "mean", r.get("levels")) for r in rows]
    if unknown := {m[3] for m in made} - set(aggregates.REGISTRY):
        raise ValueError(f"unknown aggregation: {', '.join(sorted(unknown))}")
    return spark.createDataFrame(made, fields)


def to_number(value: Column) -> Column:
    return value.try_cast("double")


def to_time(value: Column) -> Column:
    return value.try_cast("timestamp_ntz")


def encode_binary(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isin(TRUE_LABELS), 1.0).when(low.isin(FALSE_LABELS), 0.0)


def encode_ordinal(value: Column, levels: Column) -> Column:
    """Position of the value among the levels, after trimming and lower-casing both; the last of equal levels."""
    key = F.lower(F.trim(value))
    tidy = F.transform(levels, lambda x: F.lower(F.trim(x)))
    place = F.array_max(F.transform(tidy, lambda x, i: F.when(x == key, i)))
    return place.cast("double")


def category_codes(obs: DataFrame) -> DataFrame:
    """(indicator, label, code): the indicator's distinct values in order, numbered from 0; of values that differ only in
    case or blanks the last number counts for all."""
    own = obs.where("value is not null").select("indicator", "value").distinct()
    numbered = own.withColumn("code", F.row_number().over(Window.partitionBy("indicator").orderBy("value")) - 1)
    return numbered.groupBy("indicator", F.lower(F.trim("value")).alias("label")).agg(F.max("code").cast("double").alias("code"))


def encode(obs: DataFrame, dims: DataFrame) -> DataFrame:
    """Known observations with their dimension columns and `v`: labels of binary, ordinal and categorical indicators as
    numbers, other values parsed; null where that fails. NaN stays."""
    known = obs.join(dims, "indicator")
    codes = category_codes(known.where("dtype = 'categorical' or (dtype = 'ordinal' and levels is null)"))
    codes = codes.select(F.col("indicator").alias("_i"), F.col("label").alias("_l"), F.col("code").alias("_code"))
    wide = known.join(codes, (F.col("indicator") == F.col("_i")) & (F.lower(F.trim("value")) == F.col("_l")), "left")
    v = (
        F.when(F.col("dtype") == "binary", encode_binary(F.col("value")))
        .when((F.col("dtype") == "ordinal") & F.col("levels").isNotNull(), encode_ordinal(F.col("value"), F.col("levels")))
        .when(F.col("dtype").isin("ordinal", "categorical"), F.col("_code"))
        .otherwise(to_number(F.col("value")))
    )
    return wide.withColumn("v", v).drop("_i", "_l", "_code")


def parsed(obs: DataFrame, dims: DataFrame, coded: bool = True) -> DataFrame:
    """(indicator, granularity, aggregation, v, ts, seq) of known observations that have a number and a time."""
    rows = encode(obs, dims) if coded else obs.join(dims, "indicator").withColumn("v", to_number(F.col("value")))
    rows = rows.select("indicator", "granularity", "aggregation", "v", to_time(F.col("timestamp")).alias("ts"), F.col("ingest_seq").alias("seq"))
    return rows.where("v is not null and ts is not null")


def bucket(ts: Column, granularity: Column | str) -> Column:
    """Start of the calendar period; weeks begin on Monday. Null for other granularities."""
    if isinstance(granularity, str):
        return F.date_trunc(TRUNC[granularity], ts).cast("timestamp_ntz")
    out = F.lit(None).cast("timestamp_ntz")
    for name, unit in TRUNC.items():
        out = F.when(granularity == name, F.date_trunc(unit, ts).cast("timestamp_ntz")).otherwise(out)
    return out


def aggregate(obs: DataFrame, dims: DataFrame, names: list[str] | None = None, coded: bool = True) -> DataFrame:
    """(indicator, granularity, time_bucket, value) of all bucketed indicators in one pass. names: the aggregations that
    dims uses, if known; otherwise they are looked up. Indicators of unknown granularity are left out."""
    names = names or sorted(r.aggregation for r in dims.select("aggregation").distinct().collect())
    rows = parsed(obs, dims, coded).where(F.col("granularity").isin(list(TRUNC)))
    rows = rows.withColumn("time_bucket", bucket(F.col("ts"), F.col("granularity")))
    keys = ["indicator", "granularity", "aggregation", "time_bucket"]
    value = F.lit(None).cast("double")
    for name in names:
        value = F.when(F.col("aggregation") == name, aggregates.REGISTRY[name]().cast("double")).otherwise(value)
    return aggregates.prepare(rows, keys, names).groupBy(*keys).agg(value.alias("value")).drop("aggregation")


def finest(obs: DataFrame, dims: DataFrame, coded: bool = True) -> DataFrame:
    """Distinct (indicator, time, value) of the indicators that are not bucketed, in the columns of `aggregate`."""
    rows = parsed(obs, dims, coded).where("granularity = 'finest'").select("indicator", "granularity", F.col("ts").alias("time_bucket"), F.col("v").alias("value"))
    return rows.dropDuplicates(["indicator", "time_bucket", "value"])


def flatten(obs: DataFrame, dims: DataFrame, names: list[str] | None = None, coded: bool = True) -> DataFrame:
    """All grains in one long table."""
    return aggregate(obs, dims, names, coded).unionByName(finest(obs, dims, coded))


def profile(obs: DataFrame) -> DataFrame:
    """Per indicator: rows, n (numeric values), mean, std, lowest and highest value."""
    v = to_number(F.col("value"))
    return obs.groupBy("indicator").agg(F.count("*").alias("rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
