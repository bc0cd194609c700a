"""Model specifications in JSON, as the tables that `operators.specs` and `operators.identify` read, and what is said of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.specs import value_fits
from tideline.sources.activity import json_text

CONSTRUCT = "struct<name: string, description: string, role: string, temporal_status: string, causal_granularity: string, is_outcome: boolean>"
EDGE = "struct<cause: string, effect: string, description: string, lagged: boolean>"
INDICATOR = "struct<name: string, construct: string, construct_name: string, how_to_measure: string, measurement_granularity: string, measurement_dtype: string, aggregation: string, ordinal_levels: array<string>>"
MODEL = f"latent struct<constructs: array<{CONSTRUCT}>, edges: array<{EDGE}>>, measurement struct<indicators: array<{INDICATOR}>>"
#: What an indicator is where nothing is said.
DEFAULTS = {"granularity": "finest", "dtype": "continuous", "aggregation": "mean"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, json) of files that hold one specification each; the key is the file's name."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("key"), F.col("value").alias("json"))


def parsed(models: DataFrame) -> DataFrame:
    """(key, latent, measurement) of models (key, json); latent is null where the text is no JSON or has no constructs."""
    return models.select("key", F.from_json("json", MODEL).alias("m")).select("key", F.when(F.col("m.latent.constructs").isNotNull(), F.col("m.latent")).alias("latent"), "m.measurement")


def constructs(own: DataFrame) -> DataFrame:
    """(key, name, role, temporal_status, granularity, is_outcome); a construct varies over time unless it says otherwise."""
    x = own.select("key", F.explode("latent.constructs").alias("c"))
    return x.select(
        "key", "c.name", "c.role", F.coalesce("c.temporal_status", F.lit("time_varying")).alias("temporal_status"),
        F.col("c.causal_granularity").alias("granularity"), F.coalesce("c.is_outcome", F.lit(False)).alias("is_outcome")
    )


def edges(own: DataFrame) -> DataFrame:
    """(key, cause, effect, lagged); an edge is within a time step unless it says otherwise."""
    return own.select("key", F.explode("latent.edges").alias("e")).select("key", "e.cause", "e.effect", F.coalesce("e.lagged", F.lit(False)).alias("lagged"))


def indicators(own: DataFrame) -> DataFrame:
    """(key, name, construct, granularity, dtype, aggregation, how_to_measure), with DEFAULTS; none for a model without a
    measurement part."""
    x = own.where("latent is not null").select("key", F.explode("measurement.indicators").alias("i"))
    said = {"granularity": "i.measurement_granularity", "dtype": "i.measurement_dtype", "aggregation": "i.aggregation"}
    return x.select("key", "i.name", F.coalesce("i.construct_name", "i.construct").alias("construct"), *[F.coalesce(c, F.lit(DEFAULTS[k])).alias(k) for k, c in said.items()], "i.how_to_measure")


def faults(own: DataFrame) -> DataFrame:
    """(key, fault) of models that cannot be used: no constructs, or an edge whose end is none of them."""
    names, arrows = constructs(own).select("key", "name").distinct(), edges(own)
    parts = [arrows.join(names.withColumnRenamed("name", end), ["key", end], "left_anti").select("key", F.concat(F.lit(f"unknown {end}: "), end).alias("fault")) for end in ("cause", "effect")]
    return own.where("latent is null").select("key", F.lit("no constructs").alias("fault")).unionByName(parts[0]).unionByName(parts[1]).distinct()


def graph_tables(nodes: DataFrame, measured: DataFrame) -> DataFrame:
    """(key, name, observed, varying, is_outcome) for `identify.effects`: a construct is observed if an indicator names it."""
    seen = measured.where("coalesce(construct, '') <> ''").select("key", F.col("construct").alias("name"), F.lit(True).alias("observed")).distinct()
    return nodes.join(seen, ["key", "name"], "left").select(
        "key", "name", F.coalesce("observed", F.lit(False)).alias("observed"), (F.col("temporal_status") != "time_invariant").alias("varying"),
        "is_outcome"
    )


def with_proxies(measured: DataFrame, proxies: DataFrame) -> DataFrame:
    """measured (indicators) and proxies for constructs (key, construct, justification, name, and of granularity, dtype,
    aggregation and how_to_measure what is known): rows with nothing but a name say what they stand for."""
    bare = F.col("how_to_measure").isNull()
    text = F.when(
        bare | (F.coalesce("justification", F.lit("")) != ""),
        F.concat(F.lit("Proxy for "), "construct", F.lit(": "), F.when(bare, F.coalesce("justification", F.lit(""))).otherwise(F.col("how_to_measure")))
    ).otherwise(F.col("how_to_measure"))
    more = proxies.select("key", "name", "construct", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in DEFAULTS.items()], text.alias("how_to_measure"))
    return measured.unionByName(more)


def counts(measured: DataFrame) -> DataFrame:
    """(key, kind, value, n): indicators by granularity and by dtype."""
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("granularity", "dtype")]))
    return measured.select("key", kinds.alias("x")).groupBy("key", "x.kind", "x.value").agg(F.count("*").alias("n"))


def by_construct(measured: DataFrame) -> DataFrame:
    """(key, construct, indicators): name, dtype, granularity and aggregation of each construct's indicators, by name. A
    construct's indicators are written by a person and fit a row."""
    held = F.sort_array(F.collect_list(F.struct("name", "dtype", "granularity", "aggregation")))
    return measured.groupBy("key", F.coalesce("construct", F.lit("unknown")).alias("construct")).agg(held.alias("indicators"))


def overview(values: DataFrame, shown: int = 3) -> DataFrame:
    """(granularity, times, indicators, indicator, mean, std) of values (granularity, indicator, time_bucket, value): sizes of
    each granularity, and the first few indicators by name with their moments."""
    sizes = values.groupBy("granularity").agg(F.count_distinct("time_bucket").alias("times"), F.count_distinct("indicator").alias("indicators"))
    moments = values.groupBy("granularity", "indicator").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    names = moments.groupBy("granularity").agg(F.slice(F.sort_array(F.collect_list("indicator")), 1, shown).alias("first"))
    few = moments.join(names, "granularity").where(F.array_contains("first", F.col("indicator"))).drop("first")
    return sizes.join(few, "granularity").select("granularity", "times", "indicators", "indicator", "mean", "std")


def extractions(completions: DataFrame) -> DataFrame:
    """(chunk_id, indicator, value, kind, timestamp, fault) of what an extractor said of chunks (chunk_id, completion): a
    JSON object with a list of extractions, in a fence or not. kind is what a value was in JSON. A chunk without such a
    list has one row, with its fault."""
    said = completions.select("chunk_id", F.try_parse_json(json_text(F.coalesce("completion", F.lit("")))).alias("j"))
    listed = said.select("chunk_id", F.col("j").isNotNull().alias("is_json"), F.try_variant_get("j", "$.extractions", "array<variant>").alias("x"))
    fault = F.when(~F.col("is_json"), "no JSON").when(F.col("x").isNull(), "no list of extractions")
    each = listed.select("chunk_id", fault.alias("fault"), F.explode_outer("x").alias("x")).where("fault is not null or x is not null")
    get = lambda path, kind: F.try_variant_get("x", path, kind)
    schema = F.schema_of_variant(get("$.value", "variant"))
    kind = F.when(schema == "BIGINT", "integer").when(schema == "BOOLEAN", "boolean").when(schema == "STRING", "string").when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "number").otherwise("other")
    return each.select(
        "chunk_id", get("$.indicator", "string").alias("indicator"), get("$.value", "string").alias("value"), kind.alias("kind"),
        get("$.timestamp", "string").alias("timestamp"), "fault"
    )


def observed(said: DataFrame, measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw observations (indicator, value, timestamp, ingest_seq) of chunks without fault, and (chunk_id, fault) of the
    others. measured: the indicators of one specification."""
    own = measured.groupBy(F.col("name").alias("indicator")).agg(F.max("dtype").alias("dtype"), F.lit(True).alias("known"))
    held = said.join(own, "indicator", "left")
    fits = value_fits(F.col("value"), F.col("kind"), F.col("dtype"))
    named = lambda text: F.concat(F.coalesce("indicator", F.lit("?")), F.lit(f": {text}"))
    fault = F.coalesce("fault", F.when(F.col("known").isNull(), named("unknown indicator")).when(~fits, named("value does not fit the dtype")))
    judged = held.withColumn("fault", fault)
    faults_ = judged.where("fault is not null").select("chunk_id", "fault").distinct()
    fine = said.join(faults_.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return fine.select("indicator", "value", "timestamp", F.col("chunk_id").alias("ingest_seq")), faults_
