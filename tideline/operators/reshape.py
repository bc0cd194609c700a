"""Long observations to wide panels and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_DT = 1e-6
MICROS = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def pivot(long: DataFrame, names: list[str], time: str = "time_bucket") -> DataFrame:
    """One row for each time, one column for each named indicator; several values of one time are averaged. The names
    come from the spec: no job looks for them. Rows without a time are left out."""
    return long.where(F.col(time).isNotNull()).groupBy(F.col(time).alias("time")).pivot("indicator", names).agg(F.avg("value"))


def fractional_days(wide: DataFrame) -> DataFrame:
    """`time` as days since the first time, by whole seconds; the first time is a scalar subquery."""
    first = wide.agg(F.min(micros(F.col("time")))).scalar()
    return wide.withColumn("time", F.floor((micros(F.col("time")) - first) / MICROS) / 86400.0)


def intervals(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """rows with `dt`, the days since the row before within keys; MIN_DT for the first."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    return rows.withColumn("dt", F.coalesce(F.col(time) - before, F.lit(MIN_DT)))


def unpivot_draws(draws: DataFrame, params: list[str]) -> DataFrame:
    """(draw, param, value): array columns become name[k], plain columns keep their name."""
    kinds = dict(draws.dtypes)
    parts = []
    for p in params:
        if kinds[p].startswith("array"):
            parts.append(draws.select("draw", F.posexplode(p).alias("k", "value")).select("draw", F.format_string(f"{p}[%d]", "k").alias("param"), F.col("value").cast("double").alias("value")))
        else:
            parts.append(draws.select("draw", F.lit(p).alias("param"), F.col(p).cast("double").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
