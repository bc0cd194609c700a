"""Every registered query with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.plans import aggregation, causal, fits, posterior, quality, specs, states, text

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [aggregation, quality, text, causal, specs, states, fits, posterior]


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
