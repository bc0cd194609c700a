"""Session settings and table access shared by all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "tideline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; anything in conf wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
