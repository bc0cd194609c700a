"""Data-quality rules over raw observations: each yields issue rows (indicator, rule, issue_type, severity, metric).

Most rules read one profile of an indicator; the others need the order of its values or times. Values are judged as they
stand, before labels are encoded, unless `coded` observations are passed in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.quantiles import quantiles
from tideline.lineage import cut
from tideline.operators import observations as ob
from tideline.operators.reshape import micros

#: Thresholds of the rules: fixed values.
MIN_OBSERVATIONS, MIN_PERIODS, GAP_PERIODS, IQR_FACTOR, MIN_ALIGNED, DUPLICATE_SHARE = 10, 10, 5, 3.0, 10, 0.5
MIN_ARITHMETIC, BAD_TIMES = 5, 0.5
#: Parts that an indicator's values are sorted in.
CELLS = 4096

ISSUE = ["indicator", "rule", "issue_type", "severity", "metric"]


def _issues(rows: DataFrame, rule: str, kind: str, severity: Column | str, metric: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select("indicator", F.lit(rule).alias("rule"), F.lit(kind).alias("issue_type"), severity.alias("severity"), metric.cast("double").alias("metric"))


def consecutive(rows: DataFrame) -> DataFrame:
    """(indicator, n, least, most): how many values x each indicator has, and the least and most that neighbours in order
    differ by. cell: any number that does not fall as x grows. Values are sorted within cells, and only the cells' ends
    within an indicator, so that no task has to sort an indicator."""
    step = F.col("x") - F.lag("x").over(Window.partitionBy("indicator", "cell").orderBy("x"))
    cells = rows.withColumn("step", step).groupBy("indicator", "cell").agg(
        F.count("*").alias("n"), F.min("x").alias("first"), F.max("x").alias("last"), F.min("step").alias("least"), F.max("step").alias("most")
    )
    cells = cells.withColumn("between", F.col("first") - F.lag("last").over(Window.partitionBy("indicator").orderBy("cell")))
    return cells.groupBy("indicator").agg(F.sum("n").alias("n"), F.least(F.min("least"), F.min("between")).alias("least"), F.greatest(F.max("most"), F.max("between")).alias("most"))


class Report:
    """obs: raw observations; dims: indicator, construct, dtype (null: not declared), granularity (null: none)."""

    def __init__(self, obs: DataFrame, dims: DataFrame):
        self.dims = dims
        self.hours = F.create_map(*[x for k, h in ob.HOURS.items() for x in (F.lit(k), F.lit(h))])[F.col("granularity")]
        self.obs = obs
        self.rows = obs.join(dims, "indicator").withColumn("v", ob.to_number(F.col("value"))).withColumn("ts", ob.to_time(F.col("timestamp")))
        v = F.col("v")
        self.profile = self.rows.groupBy("indicator", "construct", "dtype", "granularity").agg(
            F.count("*").alias("rows"), F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.count("ts").alias("timed"),
            (F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))).alias("span"),
            F.count_if(~v.isin(0.0, 1.0)).alias("not_binary"), F.count_if(v < 0).alias("negative"), F.count_if(v % 1 != 0).alias("fraction"),
        )
        self.judged = self.profile.where("n > 0")  # an indicator without numbers is reported once and not judged further
        self.numeric = self.rows.where("v is not null")

    def no_data(self) -> DataFrame:
        empty = self.obs.agg(F.count("*").alias("n")).where("n = 0").withColumn("indicator", F.lit("all"))
        return _issues(empty, "V1", "no_data", "error", F.col("n"))

    def missing(self) -> DataFrame:
        return _issues(self.dims.join(self.profile.select("indicator"), "indicator", "left_anti"), "V2", "missing", "warning", F.lit(0))

    def no_numeric(self) -> DataFrame:
        return _issues(self.profile.where("n = 0"), "V3", "no_numeric", "error", F.col("rows"))

    def low_n(self) -> DataFrame:
        return _issues(self.judged.where(F.col("n") < MIN_OBSERVATIONS), "V4", "low_n", "warning", F.col("n"))

    def no_variance(self) -> DataFrame:
        return _issues(self.judged.where("n > 1 and low = high"), "V5", "no_variance", "error", F.col("low"))

    def bad_times(self) -> DataFrame:
        share = (F.col("rows") - F.col("timed")) / F.col("rows")
        severity = F.when(F.col("timed") == 0, "error").otherwise("warning")
        return _issues(self.judged.where(share > BAD_TIMES), "V6-V7", "unparseable_timestamps", severity, share)

    def dtype(self) -> DataFrame:
        p = self.judged
        parts = [
            _issues(p.where("dtype = 'binary' and not_binary > 0"), "V8", "dtype_violation", "error", F.col("not_binary")),
            _issues(p.where("dtype = 'count' and negative > 0"), "V9", "dtype_violation", "error", F.col("negative")),
            _issues(p.where("dtype = 'count' and fraction > 0"), "V10", "dtype_violation", "error", F.col("fraction")),
        ]
        return reduce(DataFrame.unionByName, parts)

    def outliers(self) -> DataFrame:
        own = self.numeric.where("dtype = 'continuous'")
        sizes = self.judged.select("indicator", "n")
        quartiles = quantiles(own, ["indicator"], "v", {"q1": 0.25, "q3": 0.75}, nearest=True).join(sizes, "indicator").where(f"n >= {MIN_OBSERVATIONS} and q3 > q1")
        reach = IQR_FACTOR * (F.col("q3") - F.col("q1"))
        far = own.join(quartiles, "indicator").where((F.col("v") < F.col("q1") - reach) | (F.col("v") > F.col("q3") + reach))
        return _issues(far.groupBy("indicator").agg(F.count("*").alias("far")), "V11", "dtype_violation", "warning", F.col("far"))

    def coverage(self) -> DataFrame:
        hours = F.col("span") / 3.6e9
        return _issues(self.judged.where((F.col("timed") >= 2) & (hours < MIN_PERIODS * self.hours)), "V12", "insufficient_coverage", "warning", hours)

    def gaps(self) -> DataFrame:
        timed = self.rows.join(self.judged.select("indicator"), "indicator", "left_semi").where("ts is not null")
        hours = micros(F.col("ts")) / 3.6e9
        steps = consecutive(timed.select("indicator", micros(F.col("ts")).alias("x"), F.floor(hours).alias("cell")))
        widest = steps.join(self.dims.select("indicator", "granularity"), "indicator").withColumn("widest", F.col("most") / 3.6e9)
        return _issues(widest.where((F.col("n") >= 3) & (F.col("widest") > GAP_PERIODS * self.hours)), "V13", "large_timestamp_gap", "warning", F.col("widest"))

    def duplicates(self) -> DataFrame:
        """An undeclared dtype counts as continuous here, and here only."""
        own = self.numeric.where("coalesce(dtype, 'continuous') not in ('binary', 'count')")
        top = own.groupBy("indicator", "v").agg(F.count("*").alias("k")).groupBy("indicator").agg((F.max("k") / F.sum("k")).alias("share"), F.sum("k").alias("n"), F.count("*").alias("values"))
        return _issues(top.where((F.col("n") >= 2) & (F.col("values") > 1) & (F.col("share") > DUPLICATE_SHARE)), "V14", "suspicious_pattern", "warning", F.col("share"))

    def arithmetic(self) -> DataFrame:
        ends = self.judged.select("indicator", "low", "high")
        cell = F.coalesce(F.floor((F.col("v") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * CELLS), F.lit(0))
        steps = consecutive(self.numeric.join(ends, "indicator").select("indicator", F.col("v").alias("x"), cell.alias("cell")))
        return _issues(steps.where((F.col("n") >= MIN_ARITHMETIC) & (F.col("least") == F.col("most")) & (F.col("least") != 0)), "V15", "suspicious_pattern", "warning", F.col("least"))

    def construct_correlation(self) -> DataFrame:
        """Pairs of a construct's indicators whose daily means go against each other; reported for the construct."""
        daily = self.numeric.where("ts is not null and construct is not null").groupBy("construct", "indicator", F.date_trunc("day", "ts").alias("day")).agg(F.avg("v").alias("v"))
        other = daily.select("construct", "day", F.col("indicator").alias("other"), F.col("v").alias("w"))
        pairs = daily.join(other, ["construct", "day"]).where("indicator < other").groupBy("construct", "indicator", "other")
        spread = F.nullif(F.stddev_samp("v") * F.stddev_samp("w"), F.lit(0.0))
        r = pairs.agg(F.count("*").alias("n"), (F.covar_samp("v", "w") / spread).alias("r")).where((F.col("n") >= MIN_ALIGNED) & (F.col("r") < 0))
        return _issues(r.withColumn("indicator", F.col("construct")), "V16", "low_construct_correlation", "warning", F.col("r"))

    def rules(self) -> list[DataFrame]:
        return [
            self.no_data(), self.missing(), self.no_numeric(), self.low_n(), self.no_variance(), self.bad_times(), self.dtype(), self.outliers(),
            self.coverage(), self.gaps(), self.duplicates(), self.arithmetic(), self.construct_correlation()
        ]

    def held(self) -> Report:
        """The report with its rows and its profile written down, so that the rules do not read the source one by one."""
        self.rows = cut(self.rows)
        self.profile = cut(self.profile)
        self.judged, self.numeric = self.profile.where("n > 0"), self.rows.where("v is not null")
        return self

    def issues(self) -> DataFrame:
        self.held()
        return reduce(DataFrame.unionByName, self.rules())

    def verdict(self) -> DataFrame:
        """One row: is_valid (no error), and how many errors and warnings there are."""
        found = self.issues().agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
        return found.select((F.col("errors") == 0).alias("is_valid"), "errors", "warnings")
