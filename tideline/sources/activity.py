"""Activity records and text: JSON arrays, zipped exports, lines, chunks and what is read out of them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "title string, time string, locationInfos array<struct<url: string>>"
#: What a title begins with, and the type that it stands for: fixed values.
PREFIXES = {"Searched for ": "search", "Visited ": "visit", "Viewed ": "view"}
CENTER = r"center=([0-9.-]+),([0-9.-]+)"
#: Formats of dates in free text, tried in this order: fixed values.
DATE_FORMATS = [
    "%Y-%m-%d",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%dT%H:%M:%SZ",
    "%Y-%m-%dT%H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S.%fZ",
    "%Y-%m-%dT%H:%M:%S%z",
    "%Y/%m/%d",
    "%d-%m-%Y",
    "%d/%m/%Y",
    "%m-%d-%Y",
    "%m/%d/%Y",
]
#: What each directive takes: one or two digits, leading zeros or not.
DIRECTIVES = {
    "Y": r"(\d{4})", "m": r"(1[0-2]|0?[1-9])", "d": r"(3[01]|[12]\d|0?[1-9])", "H": r"(?:2[0-3]|[01]?\d)", "M": r"[0-5]?\d", "S": r"(?:6[01]|[0-5]?\d)",
    "f": r"\d{1,6}", "z": r"(?:Z|[+-]\d\d:?[0-5]\d)",
}
#: The offset that ends a time, if any.
OFFSET = r"(?:Z|([+-])(\d\d):?(\d\d))$"


def newest(spark: SparkSession, folder: str, suffix: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path) of the file of this suffix that was changed last, the larger name of two; only metadata is read. Files whose
    names are in exclude do not count; null where none is left."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    files = files.where(~F.element_at(F.split("path", "/"), -1).isin(*exclude)) if exclude else files
    return files.agg(F.max(F.struct("modificationTime", "path")).alias("x")).select("x.path")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that hold one JSON array each."""
    return spark.read.schema(RECORD).option("multiLine", True).json(path)


def read_zip(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Records of one member of zip files: a JSON array. A file without it, or that is no zip, fails the job by name."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    text = zipfile.ZipFile(io.BytesIO(content)).read(member).decode("utf-8")
                except (KeyError, zipfile.BadZipFile) as e:
                    raise ValueError(f"{name}: no {member}") from e
                yield pa.RecordBatch.from_arrays([pa.array([text])], names=["json"])

    held = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "json string")
    return held.select(F.explode(F.from_json("json", f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in RECORD.split(', '))}>>")).alias("r")).select("r.*")


def parse(records: DataFrame) -> DataFrame:
    """(ts, offset_minutes, activity_type, content, location) of records with a title and a time; the rest of the columns
    stay. ts is in UTC; offset_minutes is what the time said, null for a time without offset (read as UTC). A time that
    cannot be parsed fails the job."""
    own = records.where("coalesce(title, '') <> '' and coalesce(time, '') <> ''")
    kind, content = F.lit("other"), F.col("title")
    for prefix, name in PREFIXES.items():
        at = F.startswith(F.col("title"), F.lit(prefix))
        kind = F.when(at, name).otherwise(kind)
        content = F.when(at, F.substring("title", len(prefix) + 1, 1 << 30)).otherwise(content)
    ts = F.to_timestamp("time").cast("timestamp_ntz")
    part = lambda k: F.regexp_extract("time", OFFSET, k)
    minutes = F.when(part(1) == "-", -1).otherwise(1) * (part(2).try_cast("int") * 60 + part(3).try_cast("int"))
    offset = F.when(F.endswith("time", F.lit("Z")), 0).otherwise(minutes)
    out = own.withColumns({"ts": ts, "offset_minutes": offset, "activity_type": kind, "content": content, "location": location(F.get("locationInfos", F.lit(0))["url"])})
    return out.drop("title", "time", "locationInfos")


def location(url: Column) -> Column:
    """"lat,lon" of a map address, or null."""
    return F.substring(F.regexp_substr(url, F.lit(CENTER)), len("center=") + 1, 1 << 30)


def iso(ts: Column, offset_minutes: Column) -> Column:
    """A time in ISO 8601 as it was said: local to its offset, with microseconds where there are any."""
    local = ts + F.make_dt_interval(mins=F.coalesce(offset_minutes, F.lit(0)))
    shown = F.when(F.extract(F.lit("second"), local) % 1 == 0, F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    size = F.abs(offset_minutes)
    zone = F.concat(F.when(offset_minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    return F.concat(shown, F.coalesce(zone, F.lit("")))


def render(ts: Column, offset_minutes: Column, kind: Column, content: Column, place: Column) -> Column:
    where = F.coalesce(F.concat(F.lit(" @ "), F.nullif(place, F.lit(""))), F.lit(""))
    return F.concat(F.lit("["), iso(ts, offset_minutes), F.lit("]"), where, F.lit(" ["), kind, F.lit("] "), content)


def lines(content: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(content, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def chunks(rows: Column, size: int) -> Column:
    """Runs of `size` neighbouring lines, joined; no shuffle, since a text's lines are in its row."""
    count = F.ceil(F.size(rows) / F.lit(size)).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.array_join(F.slice(rows, k * size + 1, F.lit(size)), "\n"))
    return F.when(count > 0, made).otherwise(F.array().cast("array<string>"))


def sample(items: Column, n: int, key: Column, seed: int = 0) -> Column:
    """One item of each of n equal segments, chosen by a hash of key, segment and seed; all items if there are no more."""
    total = F.size(items)
    cut = lambda s: F.floor(s * total / F.lit(n)).cast("int")
    pick = lambda s: cut(s) + F.pmod(F.xxhash64(key, s, F.lit(seed)), F.greatest(cut(s + 1) - cut(s), F.lit(1))).cast("int")
    return F.when(total <= n, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.element_at(items, pick(s) + 1)))


def json_text(content: Column) -> Column:
    """What stands in a fence marked json, else in any fence, else the whole text."""
    tagged, plain = F.regexp_extract(content, r"(?s)```json\s*(.*?)```", 1), F.regexp_extract(content, r"(?s)```\s*(.*?)```", 1)
    return F.trim(F.when(tagged != "", tagged).when(plain != "", plain).otherwise(content))


def spell_date(content: Column) -> Column:
    """A date in the first of DATE_FORMATS that takes it, in words; null for others and for days that no month has."""
    text, found = F.regexp_replace(content, r"^\s+|\s+$", ""), []
    for f in DATE_FORMATS:
        names = re.findall("%(.)", f)
        pattern = "^" + re.sub("%(.)", lambda m: DIRECTIVES[m[1]], f.replace(".", r"\.")) + "$"
        parts = {k: F.regexp_extract(text, pattern, 1 + [n for n in names if n in "Ymd"].index(k)) for k in "Ymd"}
        found.append(F.try_to_date(F.concat(parts["Y"], F.lit("-"), F.lpad(parts["m"], 2, "0"), F.lit("-"), F.lpad(parts["d"], 2, "0")), "yyyy-MM-dd"))
    return F.date_format(F.coalesce(*found), "EEEE, MMMM dd, yyyy")
