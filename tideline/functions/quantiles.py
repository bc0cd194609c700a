"""Exact quantiles of large groups: sketches say where to look, and only the values there are ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Of the sketches; their ranks are off by at most one in ACCURACY, MARGIN allows for three times as much.
ACCURACY, MARGIN = 10_000, 3e-4


def quantiles(rows: DataFrame, by: list[str], column: str, wanted: dict[str, float], nearest: bool = False) -> DataFrame:
    """(by, one column for each wanted share): interpolated quantiles of the column's values that are not null, as
    `percentile` gives them; with nearest the values at the nearest ranks, halves upward. No task holds a group: values are counted below the sketched bounds and ranked between them,
    which is about 2 * MARGIN of a group for each share."""
    if not by:
        return quantiles(rows.withColumn("_g", F.lit(0)), ["_g"], column, wanted, nearest).drop("_g")
    own = rows.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_v"))
    ends = [min(max(q + s * MARGIN, 0.0), 1.0) for q in wanted.values() for s in (-1, 1)]
    bounds = own.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_e"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    share = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q"), F.col("_e")[2 * i].alias("lo"), F.col("_e")[2 * i + 1].alias("hi"))
        for i, (name, q) in enumerate(wanted.items())
    ]))
    looked = bounds.select(*by, "_n", "_low", "_high", share.alias("x")).select(*by, "_n", "x.*", "_low", "_high")
    # small groups are ranked whole; the outermost values bound what the sketch may miss at the ends
    few = F.col("_n") <= ACCURACY
    looked = looked.withColumn("lo", F.when(few | (F.col("q") <= MARGIN), F.col("_low")).otherwise(F.col("lo"))).withColumn(
        "hi", F.when(few | (F.col("q") >= 1 - MARGIN), F.col("_high")).otherwise(F.col("hi"))
    ).drop("_low", "_high")
    met = own.join(looked, by)
    counted = met.where("_v < lo").groupBy(*by, "name").agg(F.count("*").alias("_below"))
    values = met.where("_v between lo and hi").groupBy(*by, "name", "_n", "q", "_v").agg(F.count("*").alias("_c"))
    ranked = values.join(counted, [*by, "name"], "left").withColumn("_to", F.coalesce("_below", F.lit(0)) + F.sum("_c").over(Window.partitionBy(*by, "name").orderBy("_v")))
    place = F.col("q") * (F.col("_n") - 1)
    low, high = (F.round(place), F.round(place)) if nearest else (F.floor(place), F.ceil(place))
    at = lambda rank: F.max(F.when((rank >= F.col("_to") - F.col("_c")) & (rank < F.col("_to")), F.col("_v")))
    # between the bounds lie the ranks from the number of values below them to that up to them
    met_rank = (F.min(F.coalesce("_below", F.lit(0))) <= F.max(low)) & (F.max("_to") > F.max(high))
    checked = F.when(met_rank, at(low)).otherwise(F.raise_error(F.lit("a sketch was off by more than its accuracy allows")).cast("double"))
    found = ranked.groupBy(*by, "name").agg(checked.alias("a"), at(high).alias("b"), F.max(place - low).alias("f"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("f")) + F.col("b") * F.col("f"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name in wanted])
