"""Observations as they come in: bucket statistics that are added up with a bound on what is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.aggregates import REGISTRY
from tideline.operators import observations as ob

#: Statistics that can be added up value by value; order statistics need whole buckets and belong to batch runs.
RUNNING = ["mean", "sum", "min", "max", "std", "var", "count", "range", "first", "last"]
WIDTH = {"hourly": "1 hour", "daily": "1 day", "weekly": "1 week"}


def bucketed(raw: DataFrame, dims: DataFrame, late: str = "1 hour") -> DataFrame:
    """(indicator, time_bucket, granularity, RUNNING) of raw observations, streaming or not: values and times that do not
    parse are left out, as are unknown indicators and those at granularities other than WIDTH's. A bucket is given out when
    the watermark passes its end; what is later than `late` behind the newest time is dropped, by the stream's contract."""
    known = raw.join(F.broadcast(dims.select("indicator", "granularity")), "indicator")
    rows = known.select("indicator", "granularity", ob.to_number(F.col("value")).alias("v"), ob.to_time(F.col("timestamp")).cast("timestamp").alias("ts"), F.col("ingest_seq").alias("seq"))
    rows = rows.where("v is not null and ts is not null").withWatermark("ts", late)
    out = None
    for grain, width in WIDTH.items():
        offset = "4 days" if grain == "weekly" else "0 days"  # weeks begin on Mondays; the epoch was a Thursday
        own = rows.where(F.col("granularity") == grain).groupBy("indicator", "granularity", F.window("ts", width, startTime=offset).alias("w")).agg(*[REGISTRY[name]().alias(name) for name in RUNNING])
        own = own.select("indicator", F.col("w.start").cast("timestamp_ntz").alias("time_bucket"), "granularity", *RUNNING)
        out = own if out is None else out.unionByName(own)
    return out
