"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there: later steps neither repeat its work nor need the
    executors that did it. The folder is spark.checkpoint.dir. One of our own serves only on a local master, where driver
    and tasks share it; elsewhere an unset folder is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tideline-"))
    return df.checkpoint(eager=True)
