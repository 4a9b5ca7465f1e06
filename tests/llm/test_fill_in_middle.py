import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import fill_in_middle as fim

UNIT = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SHA = lambda x: hashlib.sha256(x.encode()).hexdigest()


def plain(doc_id, text):
    """The transformation by a list of all units."""
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), SHA(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, SHA(text), SHA(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return n, form, len(pre), len(mid), SHA(out), SHA(text)


@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85 aé字😀<PSM>", max_size=60), st.integers(1, 5), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_every_cut_of_an_index(text, step, block):
    units = UNIT.findall(text)
    index = fim.Checkpoints(text.encode(), step, block)
    assert index.units == len(units) and index.at_unit == list(range(0, len(index.at_unit) * step, step))
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert index.cut(k) == (len(head.encode()), len(head))


def test_equal_to_lists_of_units(spark):
    texts = [None, "", " ", "\n \t", "one", " lead", "trail ", "a <P> b c d", "é字 😀 x<", "<S <", "a\x85b c d e", "\r\nq\x0bw\x0ce", "word " * 200_000, "x" * 300_000, "< S> <M c d " * 9]
    rows = [(k, t) for t in texts for k in (*range(40), None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = fim.op12_fill_in_middle(docs).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(i, *plain(i, t)) for i, t in rows], key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_restored_where_parts_look_like_markers(spark, form):
    parts = [("<", "<S", "M><"), ("", "", ""), ("<P", "P>", "S>"), ("a<S", "", "<M"), ("é", "字<", "😀")]
    outs = [(f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", p + m + s) for p, m, s in parts]
    rows = spark.createDataFrame(outs, "output string, want string")
    assert all(r[0] == r[1] for r in rows.select(fim.restored(F.col("output"), F.lit(form)), "want").collect())


def test_other_columns_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", "z", 2.0)], "doc_id long, text string, row string, fim string, form string, `a.b` double")
    found = fim.fill_in_middle(docs)
    assert found.columns == ["doc_id", "text", "row", "form", "a.b", "fim"]
    assert found.first()[:5] == (1, "a b c", "x", "z", 2.0)
    assert fim.op12_fill_in_middle(docs.limit(0)).count() == 0
    every = fim.fill_in_middle(docs, share=100, suffix_first=0, seed=3).first().fim
    assert every.form == "psm" and every.output.startswith("<P>")
