import time

import pytest
from pyspark.sql import functions as F

from tideline.llm import graph, spark_io


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x.rsplit("/", 1)[-1] for x in found.mkString("\n").split("\n") if "/shuffle_" in x}


def left(spark, before, wanted):
    """Shuffle files beyond those of before, once there are as few as wanted or 10 s are over."""
    for _ in range(50):
        if len(files := shuffle_files(spark) - before) <= wanted:
            break
        time.sleep(0.2)
    return files


def test_cut_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(spark_io.SHUFFLES_GO, None)
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = spark_io.cut(grouped)
    assert not left(spark, before, 0)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, grouped.collect()))
    assert spark.conf.get(spark_io.SHUFFLES_GO, None) == setting


@pytest.mark.parametrize("part_edges", [1 << 18, 50])
def test_a_round_is_written_in_the_parts_that_its_edges_need(spark, part_edges, monkeypatch):
    """With as many partitions as on a cluster, 200 edges are one part."""
    parts = []
    monkeypatch.setattr(graph, "cut", lambda df: parts.append((out := spark_io.cut(df)).rdd.getNumPartitions()) or out)
    held = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        got = sorted(map(tuple, graph.components(edges, part_edges=part_edges).collect()))
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)
    assert got == [(k, 0) for k in range(1, 201)]
    assert part_edges < 200 or set(parts[1:]) == {1}
