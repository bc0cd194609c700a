"""Documents that hold passages of a benchmark, by SimHash of windows of the benchmark items' sizes.

Only DataFrame functions are used. A document's windows of an item's size are those that have a shingle of an item of
that size at the same offset (moved to the text's ends where they would reach beyond). Windows that share shingles at
other offsets only are not looked at; a copy with words put in or left out has aligned windows on either side. Their
SimHash fingerprints are looked up in a multi-index of the items' fingerprints: BLOCKS blocks of bits, of which one
differs in at most radius // BLOCKS bits if the fingerprints differ in at most `radius`, so each item is stored under
every such value of each block. What is found within the radius is compared exactly: the shared weight of shingles over
their joint weight, a shingle weighing as often as it occurs. A document of fewer words than the item, but of one shingle
at least, is one window as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.spark_io import cut, sendable

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 4, 23
WORD_GAP = r"[^\p{L}\p{N}]+"
NO_ID = -(1 << 63)


def word_list(column: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(column, F.lit(""))), WORD_GAP), "")


def shingle_hashes(ws: Column, k: int) -> Column:
    """Hash of each run of k words; an empty array if there are fewer words."""
    at = lambda i, j: F.get(ws, i + j)
    n = F.size(ws)
    hashed = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[at(i, j) for j in range(k)]))
    return F.when(n >= k, hashed).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Bits that are set in over half of the hashes."""
    def bit(b: int) -> Column:
        seen = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(2 * seen > F.size(hashes), F.lit(_signed(1 << b))).otherwise(F.lit(0)).cast("bigint")

    bits = [bit(b) for b in range(BITS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _block(fp: Column, b: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned(fp, b * width).bitwiseAND(F.lit((1 << width) - 1))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, item_words, n (words), k (shingle size: SHINGLE, or all words of a shorter item), hashes. Items without
    words or id are left out; an item that occurs again counts once."""
    words_of = benchmark.where("item_id is not null").select("item_id", word_list(F.col("text")).alias("item_words")).distinct()
    sized = words_of.withColumn("n", F.size("item_words")).where("n > 0").withColumn("k", F.least(F.col("n"), F.lit(SHINGLE)))
    hashes = F.array().cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        hashes = F.when(F.col("k") == k, shingle_hashes(F.col("item_words"), k)).otherwise(hashes)
    return sized.withColumn("hashes", hashes)


def multi_index(items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """n, block, value, item_id, item_fp: every item under each value of each block that the radius allows."""
    width, most = BITS // BLOCKS, radius // BLOCKS
    changes = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit((1 << width) - 1).cast("bigint")), lambda x: F.bit_count(x) <= most)
    own = items.select("item_id", "item_words", "n", "k", simhash(F.col("hashes")).alias("item_fp"))
    blocks = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("item_fp"), b).alias("own")) for b in range(BLOCKS)]))
    return own.withColumn("x", blocks).withColumn("change", F.explode(changes)).select(
        "item_id", "item_words", "item_fp", "n", "k", F.col("x.block").alias("block"), F.col("x.own").bitwiseXOR(F.col("change")).alias("value")
    )


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, item_id, start, n, similarity: for each document and item the most similar of the aligned windows
    (the first of several), where the similarity is at least `similarity` and the fingerprints are within `radius`.

    Documents with null ids take part under a null doc_id; null and empty texts match nothing; rows that repeat give one
    row; an empty benchmark, or one of items without words or ids, matches nothing. Other columns are not read."""
    items = cut(items_of(benchmark))
    sizes = sorted(r.k for r in items.select("k").distinct().collect())  # 1 to SHINGLE
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]
    worded = docs.select(*key, word_list(F.col("text")).alias("ws"))
    anchors = items.select("n", "k", F.posexplode("hashes").alias("offset", "hash")).distinct()
    hits = None
    for k in sizes:
        rows = worded.select("doc_key", "text_hash", F.size("ws").alias("words"), F.posexplode(shingle_hashes(F.col("ws"), k)).alias("pos", "hash"))
        met = rows.join(anchors.where(F.col("k") == k), "hash")
        latest = F.greatest(F.col("words") - F.col("n"), F.lit(0))
        found = met.select("doc_key", "text_hash", "n", "k", F.least(F.greatest(F.col("pos") - F.col("offset"), F.lit(0)), latest).alias("start"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, text_hash bigint, item_id bigint, start int, n int, similarity double")
    hits = cut(hits.distinct())
    # texts are read again for the few that have a window; the hits are joined to those
    hit = worded.join(sendable(hits.select("doc_key", "text_hash").distinct()), ["doc_key", "text_hash"], "left_semi")
    windows = hit.dropDuplicates(["doc_key", "text_hash"]).join(hits, ["doc_key", "text_hash"])
    windows = windows.select("doc_key", "text_hash", "n", "k", "start", F.slice("ws", F.col("start") + 1, F.col("n")).alias("window"))
    hashes = F.array().cast("array<bigint>")
    for k in sizes:
        hashes = F.when(F.col("k") == k, shingle_hashes(F.col("window"), k)).otherwise(hashes)
    marked = cut(windows.withColumn("hashes", hashes).withColumn("fp", simhash(F.col("hashes"))).drop("hashes"))
    blocks = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("value")) for b in range(BLOCKS)]))
    looked_up = marked.select("n", "fp").distinct().select("n", "fp", blocks.alias("x")).select("n", "fp", "x.block", "x.value")
    # the index has thousands of rows for each item: too many to send to every worker
    met = looked_up.join(multi_index(items, radius).drop("item_words", "k").hint("merge"), ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = marked.join(met.select("n", "fp", "item_id").distinct(), ["n", "fp"]).select("doc_key", "text_hash", "item_id", "start", "n", "window").distinct()
    pair = ["doc_key", "text_hash", "item_id", "start", "n"]
    item = items.select(F.col("item_id").alias("_i"), F.col("n").alias("_n"), "k", "item_words")
    both = near.join(item, (F.col("item_id") == F.col("_i")) & (F.col("n") == F.col("_n")))
    parts = [(_shingles("window"), 1, 0), (_shingles("item_words"), 0, 1)]
    sides = [both.select(*pair, F.explode(column).alias("shingle"), F.lit(a).alias("a"), F.lit(b).alias("b")) for column, a, b in parts]
    weights = sides[0].unionByName(sides[1]).groupBy(*pair, "shingle").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    alike = weights.groupBy(*pair).agg((F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity")).where(F.col("similarity") >= similarity)
    best = alike.groupBy("doc_key", "text_hash", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n")).alias("best"))
    return best.select(
        F.nullif("doc_key", F.lit(NO_ID)).alias("doc_id"), "text_hash", "item_id", F.col("best.start").alias("start"), F.col("best.n").alias("n"), (-F.col("best.s")).alias("similarity")
    )


def _shingles(column: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(column) - F.col("k")), lambda i: F.array_join(F.slice(column, i + 1, F.col("k")), " "))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The documents that match no item, with all their columns, whatever they are called. Rows of equal doc_id and text go
    or stay together; null and empty texts stay."""
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])
    found = cut(matches(inner, benchmark, similarity, radius).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_d"), F.col("text_hash").alias("_t")).distinct())
    same = (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)) == F.col("_d")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_t"))
    return inner.join(sendable(found), same, "left_anti").toDF(*docs.columns)
