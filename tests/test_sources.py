import json
import os
import zipfile

from pyspark.sql import functions as F

from tideline.operators import identify
from tideline.operators import observations as ob
from tideline.sources import activity, models
from tideline.streaming import observations as stream

RECORDS = [
    {"title": "Searched for rain", "time": "2024-01-01T10:00:00Z", "locationInfos": [{"url": "https://m/?center=1.5,-2.25&z=1"}]},
    {"title": "Visited a page", "time": "2024-01-01T12:00:00.250+02:00"},
    {"title": "Something", "time": "2024-01-01T09:00:00"},
    {"title": "", "time": "2024-01-01T10:00:00Z"},
    {"title": "No time"},
]


def test_records_from_arrays_and_zip_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECORDS))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("Takeout/MyActivity.json", json.dumps(RECORDS))
    want = ["[2024-01-01T10:00:00+00:00] @ 1.5,-2.25 [search] rain", "[2024-01-01T12:00:00.250000+02:00] [visit] a page", "[2024-01-01T09:00:00] [other] Something"]
    for records in (activity.read_json(spark, str(tmp_path / "a.json")), activity.read_zip(spark, str(tmp_path / "b.zip"), "Takeout/MyActivity.json")):
        rows = activity.parse(records)
        lines = rows.select(activity.render(F.col("ts"), F.col("offset_minutes"), F.col("activity_type"), F.col("content"), F.col("location")).alias("line"), "ts")
        assert sorted(r.line for r in lines.collect()) == sorted(want)


def test_newest_file(spark, tmp_path):
    for k, name in enumerate(["old.txt", "new.txt", "own.txt", "other.csv"]):
        (tmp_path / name).write_text(name)
        os.utime(tmp_path / name, (1_700_000_000 + k, 1_700_000_000 + k))
    assert activity.newest(spark, str(tmp_path), ".txt").first().path.endswith("/own.txt")
    assert activity.newest(spark, str(tmp_path), ".txt", ("own.txt",)).first().path.endswith("/new.txt")


def test_dates_by_the_first_format_that_takes_them(spark):
    want = {
        "03/04/2024": "Wednesday, April 03, 2024", "13/04/2024": "Saturday, April 13, 2024", "04/13/2024": "Saturday, April 13, 2024", "15-03-2024": "Friday, March 15, 2024",
        "2024-03-15T10:30:00Z": "Friday, March 15, 2024", " 2024-03-15 ": "Friday, March 15, 2024", "2024-03-15T23:30:00-05:00": "Friday, March 15, 2024", "2024-3-5": "Tuesday, March 05, 2024",
        "2024-02-30": None, "2024-13-01": None, "soon": None, "": None, "2024-03-15 10:30:00": None,
    }
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", activity.spell_date(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == want


MODEL = {
    "latent": {
        "constructs": [
            {"name": "X", "role": "endogenous", "causal_granularity": "daily"},
            {"name": "Y", "role": "endogenous", "causal_granularity": "daily", "is_outcome": True},
            {"name": "U", "role": "exogenous", "temporal_status": "time_invariant"}
        ],
        "edges": [{"cause": "X", "effect": "Y"}, {"cause": "U", "effect": "Y", "lagged": False}],
    },
    "measurement": {"indicators": [{"name": "x1", "construct": "X", "measurement_dtype": "count"}, {"name": "y1", "construct_name": "Y", "how_to_measure": "ask"}]},
}


def test_models_from_files(spark, tmp_path):
    broken = {"latent": {"constructs": [{"name": "A"}], "edges": [{"cause": "A", "effect": "Ghost"}]}}
    for name, text in {"good.json": json.dumps(MODEL), "broken.json": json.dumps(broken), "empty.json": "{}", "no.json": "not json"}.items():
        (tmp_path / name).write_text(text)
    own = models.parsed(models.read(spark, str(tmp_path)))
    assert {(r.key, r.fault) for r in models.faults(own).collect()} == {("broken.json", "unknown effect: Ghost"), ("empty.json", "no constructs"), ("no.json", "no constructs")}
    good = own.where("key = 'good.json'")
    measured = models.indicators(good)
    assert sorted(tuple(r) for r in measured.select("name", "construct", "granularity", "dtype").collect()) == [("x1", "X", "finest", "count"), ("y1", "Y", "finest", "continuous")]
    verdicts = identify.effects(models.graph_tables(models.constructs(good), measured), models.edges(good)).collect()
    assert [(v.treatment, v.identifiable) for v in verdicts] == [("X", True)]
    proxies = spark.createDataFrame(
        [("good.json", "U", "often seen with", "u1", None, None, None, None), ("good.json", "U", "why", "u2", "daily", "binary", "max", "count it")],
        "key string, construct string, justification string, name string, granularity string, dtype string, aggregation string, how_to_measure string"
    )
    wide = models.with_proxies(measured, proxies)
    assert {r.name: (r.dtype, r.how_to_measure) for r in wide.where("construct = 'U'").collect()} == {"u1": ("continuous", "Proxy for U: often seen with"), "u2": ("binary", "Proxy for U: count it")}
    assert {(r.kind, r.value): r.n for r in models.counts(wide).collect()}["granularity", "finest"] == 3
    assert [i.name for i in models.by_construct(wide).where("construct = 'U'").first().indicators] == ["u1", "u2"]


def test_extractions_of_completions(spark):
    said = [
        (1, 'Here:\n```json\n{"extractions": [{"indicator": "x", "value": 3, "timestamp": "2024-01-01"}, {"indicator": "y", "value": "low"}]}\n```'),
        (2, '{"extractions": [{"indicator": "x", "value": 2.5}]}'), (3, "nothing"), (4, '{"rows": []}'), (5, '{"extractions": []}'), (6, '{"extractions": [{"indicator": "z", "value": true}]}'), (7, None),
    ]
    rows = models.extractions(spark.createDataFrame(said, "chunk_id bigint, completion string"))
    assert {r.chunk_id: r.kind for r in rows.where("value = '3' or value = '2.5' or value = 'true'").collect()} == {1: "integer", 2: "number", 6: "boolean"}
    good, bad = models.observed(rows, spark.createDataFrame([("x", "count"), ("y", "ordinal")], "name string, dtype string"))
    assert sorted(tuple(r) for r in good.collect()) == [("x", "3", "2024-01-01", 1), ("y", "low", None, 1)]
    assert {r.chunk_id: r.fault for r in bad.collect()} == {2: "x: value does not fit the dtype", 3: "no JSON", 4: "no list of extractions", 6: "z: unknown indicator", 7: "no JSON"}


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    """Files arrive one after another; closed buckets equal those of one batch over all rows."""
    rows = [("a" if k % 2 else "b", "bad" if k % 13 == 5 else str(k * 0.5), f"2024-01-{1 + k // 8:02d} {k % 8 * 3:02d}:00:00", k) for k in range(120)]
    dims = ob.indicators(spark, [{"indicator": "a", "granularity": "daily"}, {"indicator": "b", "granularity": "weekly"}])
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], ob.RAW).coalesce(1).write.json(str(tmp_path / "in" / str(part)))
    source = spark.readStream.schema(ob.RAW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    query = stream.bucketed(source, dims, "10 days").writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.indicator, r.time_bucket): r for r in spark.table("buckets").collect()}
    want = {(r.indicator, r.time_bucket): r for r in stream.bucketed(spark.createDataFrame(rows, ob.RAW), dims).collect()}
    assert len(got) >= 4 and all(got[k] == want[k] for k in got)
    batch = ob.aggregate(
        spark.createDataFrame(rows, ob.RAW),
        ob.indicators(spark, [{"indicator": "a", "granularity": "daily", "aggregation": "mean"}, {"indicator": "b", "granularity": "weekly", "aggregation": "mean"}]),
        ["mean"]
    )
    assert {(r.indicator, r.time_bucket): round(r.value, 9) for r in batch.collect()} == {k: round(r.mean, 9) for k, r in want.items()}


def test_samples_take_one_item_of_each_segment(spark):
    rows = [(k, [f"c{i}" for i in range(n)]) for k, n in enumerate([0, 3, 5, 7, 12, 100])]
    df = spark.createDataFrame(rows, "k bigint, items array<string>")
    pick = lambda seed: {r.k: r.s for r in df.select("k", activity.sample(F.col("items"), 5, F.col("k"), seed).alias("s")).collect()}
    got = pick(0)
    for k, items in rows:
        if len(items) <= 5:
            assert got[k] == items
            continue
        ends = [s * len(items) // 5 for s in range(6)]
        assert len(got[k]) == 5 and all(a <= items.index(x) < b for x, a, b in zip(got[k], ends, ends[1:]))
    assert got == pick(0) and got[5] != pick(1)[5]
