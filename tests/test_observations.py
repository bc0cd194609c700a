import pytest

from tideline.functions import aggregates
from tideline.operators import observations as ob
from tideline.operators import posterior


def test_unknown_aggregation_is_an_error(spark):
    raw = spark.createDataFrame([("a", "1", "2024-01-01", 1)], ob.RAW)
    with pytest.raises(ValueError, match="unknown aggregation: mode"):
        ob.aggregate(raw, ob.indicators(spark, [{"indicator": "a", "granularity": "daily", "aggregation": "mode"}]), ["mode"]).collect()
    with pytest.raises(ValueError, match="unknown aggregation"):
        aggregates.prepare(raw, ["indicator"], ["mean", "nope"])


def test_union_of_workers_keeps_rows_and_skips_missing_frames(spark):
    raw = spark.createDataFrame([("a", "1", "2024-01-01", 1)], ob.RAW)
    assert ob.union([raw, None, raw], spark).count() == 2
    assert ob.union([], spark).count() == 0 and ob.union([None], spark).columns == ["indicator", "value", "timestamp", "ingest_seq"]


def test_effects_are_ranked_by_size_with_ties_by_name(spark):
    rows = [(k, t, e) for t, e in (("b", -2.0), ("a", 2.0), ("c", 0.5), ("d", None)) for k in range(3)]
    got = posterior.rank_effects(spark.createDataFrame(rows, "draw int, treatment string, effect double")).orderBy("place").collect()
    assert [r.treatment for r in got] == ["a", "b", "c", "d"] and [r.place for r in got] == [1, 2, 3, 4]
    assert got[1].low == got[1].high == -2.0 and got[1].prob_positive == 0.0
