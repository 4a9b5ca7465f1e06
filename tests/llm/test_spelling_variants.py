import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import spelling_variants as sv


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


@given(st.sets(st.text("abé", min_size=1, max_size=6), max_size=30))
@settings(max_examples=300, deadline=None)
def test_walk_of_a_trie(words):
    words = sorted(words)
    got = list(sv.near_in_trie(words))
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])}


def plain(docs):
    """All rows of the query by comparing all words."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n}


def test_equal_to_comparing_all_words(spark):
    base = ["Straßenbahn", "gouvernement", "GOVERNMENT", "governmental", "aaaaaaaa", "Ärztekammer", "x" * 3000]
    text = " ".join(base * 12)
    typos = [w[:k] + c + w[k + j:] for w in base[:5] for k in (0, 1, 2, 3, 5, len(w) - 1, len(w)) for j in (0, 1) for c in ("", "q", "ÿ")]
    docs = [(k, text) for k in range(12)] + [(None, text), (3, text), (5, None), (6, ""), (7, "ÀÀ1ÀÀ short")] + [(100 + k, " ".join([w, w, "-" + w + "!"])) for k, w in enumerate(typos)]
    docs += [(200, "chainword " * 1000), (201, "chainwort " * 60), (202, "chainworts " * 3)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in sv.op13_spelling_variants(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(docs)
    assert any(r[1] is not None and r[1] != r[2] for r in got)  # a chain of forms


def test_prefixes_that_most_words_share_are_cut(spark):
    words = {"prefixed" + a + b + c for a in "abcde" for b in "abcde" for c in ("", "a", "ab", "xyzxyz")} | {"prefixed", "prefixe", "prfixed", "otherword", "othrword", "a" * 400, "a" * 401, "a" * 399 + "b"}
    rows = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = {tuple(sorted((a, b))) for a in words for b in words if near(a, b)}
    for most in (1, 2, 7, 1000):
        got = [tuple(sorted((r.a, r.b))) for r in sv.near_pairs(rows, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "wording wordings wording wordings", "x", 2)], "doc_id long, text string, word string, n int")
    assert {r.word for r in sv.op13_spelling_variants(docs).collect()} <= {"wording", "wordings", "wordins", "wrdings", "ordings"}
    assert sv.op13_spelling_variants(docs.limit(0)).count() == 0
