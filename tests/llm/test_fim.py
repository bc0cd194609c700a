"""Fill-in-the-middle against plain Python, and as an exact round trip."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from tests.compare import connect, differences
from tideline.llm import fim, queries

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "ä\nöß\n日本\n\U0001f600 end", "\r\n\r\nx y\u0085z\n", "has <P> inside\nb", "<S>", "x<M>", "<<P\n>S<\nP>M>\n<",
    "<P", "S>\n<M", " \n \n", "\0\n\0", "line\n" * 3000, "y" * 5000,
]


def plain(doc_id, text, changed=100, first=50):
    """(n, form, prefix, middle, output) as the rule is written down."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= changed:
        return n, "plain", None, None, text
    if h4 % 100 < first:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("recipe", [fim.Recipe(), fim.Recipe(changed=40, suffix_first=90)])
def test_equals_plain_python_and_is_undone(spark, recipe):
    rows = [(i * 31 + k, t, "kept", "also") for k in range(8) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc", None, None), (5, "q\nr", "", ""), (5, "q\nr", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, _cut string").repartition(3)
    out = fim.transform(docs, recipe)
    assert out.columns == ["doc_id", "text", "_cut", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted((str(r.doc_id), str(r.text), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    key = lambda d, t: plain(d, t, recipe.changed, recipe.suffix_first)
    assert got == sorted((str(d), str(t), *key(d, t)) for d, t, *_ in rows)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    back = out.where(~fim.restore(F.col("output"), F.col("form"), recipe).eqNullSafe(F.coalesce("text", F.lit(""))))
    assert back.count() == 0


def test_blocks_give_the_offsets_of_the_whole():
    splitter = pre_tokenizers.Split(Regex(fim.Recipe().unit), "isolated")
    for text in TEXTS[1:] + ["ab\n" * 50 + "c" * 40 + "\nd", "é" * 30, "x" * 20 + "\n" * 20]:
        want = np.cumsum([len(u) for u in re.findall(r"[^\n]*\n|[^\n]+", text)]).tolist()
        for block in (1, 7, 16, 1 << 18):
            assert fim.ends(text, splitter, "\n", block).tolist() == want


def test_bad_sentinels_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.transform(docs).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<S]", "<M>"), ("a>b>", "<S>", "<M>"), ("x<S>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(docs, fim.Recipe(sentinels=bad))


def test_query_equals_sql(spark):
    assert not differences(queries.queries()["op12_fim"](spark, SF), connect(SF), queries.oracles()["op12_fim"])
