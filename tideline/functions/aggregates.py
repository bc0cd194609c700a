"""The 24 statistics of an observation group, by name.

Each is a Column over one group of the columns that `prepare` adds. Statistics that depend on order use window columns
(sorted with spill), so no group is gathered into an array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = {"p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90, "p99": 0.99}


def _number() -> Column:
    return F.nanvl(F.col("v"), F.lit(None).cast("double"))


def _nearest(q: float) -> Column:
    """The value at the rank nearest to q * (n - 1), halves upward."""
    return F.max(F.when(F.col("_rank") == F.round((F.col("_n") - 1) * F.lit(q)), F.col("v")))


def _median() -> Column:
    low, high = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    return (F.max(F.when(F.col("_rank") == low, F.col("v"))) + F.max(F.when(F.col("_rank") == high, F.col("v")))) / 2


def _entropy() -> Column:
    share = F.col("v") / F.nullif(F.col("_total"), F.lit(0.0))
    term = F.when(share > 0, -share * F.ln(share)).when(share == 0, F.lit(0.0))
    return F.when(F.min("v") >= 0, F.sum(term))


def _cv() -> Column:
    return F.when(F.abs(F.avg("v")) > 1e-15, F.stddev_samp("v") / F.nullif(F.avg("v"), F.lit(0.0)))


def _trend() -> Column:
    """Least-squares slope over the positions 0 to n - 1; their sums are known."""
    n = F.count("v").cast("double")
    top = F.sum(F.col("v") * F.col("_pos")) - F.avg("v") * n * (n - 1) / 2
    return F.when(n >= 2, top / F.nullif(n * (n * n - 1) / 12, F.lit(0.0))).otherwise(F.lit(0.0))


REGISTRY: dict[str, Callable[[], Column]] = {
    "mean": lambda: F.avg("v"),
    "sum": lambda: F.sum("v"),
    "min": lambda: F.min(_number()),
    "max": lambda: F.max(_number()),
    "std": lambda: F.stddev_samp("v"),
    "var": lambda: F.var_samp("v"),
    "last": lambda: F.max_by("v", F.struct("ts", "seq")),
    "first": lambda: F.min_by("v", F.struct("ts", "seq")),
    "count": lambda: F.count("v").cast("double"),
    "median": _median,
    "n_unique": lambda: F.sum(F.col("_new").cast("double")),
    "skew": lambda: F.skewness("v"),
    "kurtosis": lambda: F.kurtosis("v"),
    "entropy": _entropy,
    **{name: (lambda q=q: _nearest(q)) for name, q in QUANTILES.items()},
    "range": lambda: F.max(_number()) - F.min(_number()),
    "iqr": lambda: _nearest(0.75) - _nearest(0.25),
    "cv": _cv,
    "instability": lambda: F.avg(F.pow(F.col("v") - F.col("_before"), 2)),
    "trend": _trend,
}

BY_VALUE = {"median", "n_unique", "iqr", *QUANTILES}
BY_TIME = {"instability", "trend"}


def prepare(rows: DataFrame, keys: list[str], names: Iterable[str]) -> DataFrame:
    """rows (keys, v, ts, seq) with the window columns that the named statistics read; none for the others."""
    names = set(names)
    if unknown := names - set(REGISTRY):
        raise ValueError(f"unknown aggregation: {', '.join(sorted(unknown))}")
    group = Window.partitionBy(*keys)
    if names & BY_VALUE:
        by_value = group.orderBy("v")
        rows = rows.withColumn("_rank", F.row_number().over(by_value) - 1).withColumn("_n", F.count("v").over(group))
        rows = rows.withColumn("_new", ~F.col("v").eqNullSafe(F.lag("v").over(by_value)) | (F.col("_rank") == 0))
    if names & BY_TIME:
        by_time = group.orderBy("ts", "seq")
        rows = rows.withColumn("_before", F.lag("v").over(by_time)).withColumn("_pos", F.row_number().over(by_time) - 1)
    if "entropy" in names:
        rows = rows.withColumn("_total", F.sum("v").over(group))
    return rows
