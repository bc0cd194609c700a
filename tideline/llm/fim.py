"""Fill-in-the-middle: a text cut into three at unit boundaries and put together with the middle last.

A Split pre-tokenizer, which needs no training, isolates the units and gives their offsets in code points; the number of
offsets is the number of units, and the offsets of two ranks are the cuts. Tasks give back three numbers a text; slicing,
assembling and restoring are column expressions.

A null text counts as empty, a null id as one without digits. Rows that repeat come out alike; ties of the two cuts leave
an empty middle. Empty texts and those that hold a sentinel stay plain, so that every output can be undone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

#: Code points that the pre-tokenizer is given at a time; a unit that is longer is given whole.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Recipe:
    """unit: pattern of a unit, whose matches cover any text and which ends at `stop` at the latest; shares are of 100."""

    unit: str = r"[^\n]*\n|[^\n]+"
    stop: str = "\n"
    seed: str = "7:"
    changed: int = 100
    suffix_first: int = 50
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")


def ends(text: str, splitter: pre_tokenizers.Split, stop: str, block: int = BLOCK) -> np.ndarray:
    """Offsets, in code points, at which the units of a text end. Long texts are given to the pre-tokenizer in blocks that
    end after a `stop`, which no unit crosses."""
    out, start = [], 0
    while start < len(text):
        end = len(text)
        if end - start > block:
            found = text.rfind(stop, start, start + block)
            found = found if found >= 0 else text.find(stop, start + block)
            end = found + len(stop) if found >= 0 else end
        out.append(np.fromiter((b for _, (_, b) in splitter.pre_tokenize_str(text[start:end])), np.int64) + start)
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cuts(text: Column, one: Column, two: Column, recipe: Recipe) -> Column:
    """(n, a, b): number of units, and where the smaller and the larger of one % (n + 1) and two % (n + 1) units end."""

    @F.arrow_udf("n bigint, a bigint, b bigint")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        splitter = pre_tokenizers.Split(Regex(recipe.unit), "isolated")
        for texts, ones, twos in batches:
            rows = np.zeros((3, len(texts)), np.int64)
            for i, (x, p, q) in enumerate(zip(texts, ones.to_pylist(), twos.to_pylist())):
                at = np.append(0, ends(x.as_py() or "", splitter, recipe.stop))
                n = len(at) - 1
                rows[:, i] = n, at[min(p % (n + 1), q % (n + 1))], at[max(p % (n + 1), q % (n + 1))]
            yield pa.StructArray.from_arrays([pa.array(r) for r in rows], names=["n", "a", "b"])

    return run(text, one, two)


def draw(key: Column, seed: str, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the hash of seed and key, as a number."""
    digits = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * k - 7, 8), 16, 10).cast("bigint")


def restore(output: Column, form: Column, recipe: Recipe = Recipe()) -> Column:
    """The text that an output stands for. No sentinel occurs in its parts, nor across a seam, since all end with a
    character that they have nowhere else."""
    p, s, m = recipe.sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def transform(docs: DataFrame, recipe: Recipe = Recipe(), key: str = "doc_id", column: str = "text") -> DataFrame:
    """docs with n, form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output; columns of
    these names are replaced. Which form a row takes and where it is cut come from its key alone."""
    marks = recipe.sentinels
    if not all(marks) or len({x[-1] for x in marks}) > 1 or any(x[-1] in x[:-1] for x in marks) or any(x.endswith(y) for i, x in enumerate(marks) for j, y in enumerate(marks) if i != j):
        raise ValueError("sentinels must share a last character that they have nowhere else, and none may end another")
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    text, h = F.coalesce(F.col(column), F.lit("")), [draw(F.col(key), recipe.seed, k) for k in (1, 2, 3, 4)]
    p, s, m = recipe.sentinels
    plain = (F.length(text) == 0) | (h[2] % 100 >= recipe.changed)
    for x in recipe.sentinels:
        plain = plain | F.contains(text, F.lit(x))
    form = F.when(plain, "plain").when(h[3] % 100 < recipe.suffix_first, "spm").otherwise("psm")
    kept = [c for c in docs.columns if c not in new]
    spot = "_cut"
    while spot in docs.columns:
        spot = "_" + spot
    a, b = F.col(f"{spot}.a").cast("int"), F.col(f"{spot}.b").cast("int")
    prefix, middle, suffix = F.substr(text, F.lit(1), a), F.substr(text, a + 1, b - a), F.substr(text, b + 1)
    cut = docs.withColumn(spot, cuts(text, h[0], h[1], recipe)).withColumn("form", form)
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
        .otherwise(F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
    )
    told = F.col("form") != "plain"
    return cut.select(
        *[F.col(f"`{c}`") for c in kept], F.col(f"{spot}.n").alias("n"), "form", F.when(told, F.col(f"{spot}.a")).alias("prefix_chars"),
        F.when(told, F.col(f"{spot}.b") - F.col(f"{spot}.a")).alias("middle_chars"), output.alias("output"),
    )


__all__ = ["Recipe", "restore", "transform"]
