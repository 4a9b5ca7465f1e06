import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.functions import wording
from lodestar.operators import languages

DOCS = "/root/testdata/sf0.01/documents.parquet"
TAUGHT = [("the house and the garden with the trees", "en"), ("The road is narrow but there is shade", "en"), ("la casa y el jardín con los árboles", "es"),
          ("la carretera es estrecha pero hay sombra", "es"), (None, "es"), ("nobody says what this is", None), ("", "en")]


def _grams(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    return [f" {w} "[i:i + 3] for w in words for i in range(len(w))]


def _plain(taught, texts):
    """Scores by Python counters: (language, lead, known trigrams) of each text."""
    counts = {}
    for text, lang in taught:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(_grams(text))
    counts = {k: v for k, v in counts.items() if v}
    kinds = len(set().union(*counts.values()))
    out = []
    for text in texts:
        seen = [g for g in _grams(text) if any(c[g] * languages.PROFILE_SHARE >= sum(c.values()) for c in counts.values())]
        by = sorted((-sum(round(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * kinds)) * 1000) for g in seen), k) for k, c in counts.items())
        out.append((by[0][1], by[1][0] - by[0][0], len(seen)) if seen else (None, None, 0))
    return out


def test_detection_equals_counters(spark):
    texts = ["The garden is narrow", "el jardín es estrecho", "", None, "12 !! 34", "ÁRBOLES con sombra\n\nthe", "zzz qqq", "the " * 5000 + "la", "𝒜the𝒜casa", "x" * 30000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("_w0", F.lit("clash")).withColumn("detected", F.lit("clash"))
    model = languages.fit(spark.createDataFrame(TAUGHT, "text string, lang string"))
    got = {r["k"]: (r["detected"], r["lead"], r["n_known"]) for r in languages.detected(rows, model, "k").collect()}
    plain = _plain(TAUGHT, [None if t is None else t.replace("𝒜", " ") for t in texts])
    assert got == dict(enumerate(plain)) and got[0][0] == "en" and got[1][0] == "es"


def test_profiles_of_one_language_or_none(spark):
    rows = spark.createDataFrame([(1, "the tree"), (None, "the"), (None, " end")], "k int, text string")
    one = languages.fit(spark.createDataFrame([("the tree", "en")], "text string, lang string"))
    assert sorted((str(r["k"]), r["detected"], r["lead"], r["n_known"]) for r in languages.detected(rows, one, "k").collect()) == [("1", "en", None, 7), ("None", "en", None, 3)]
    none = languages.fit(spark.createDataFrame([], "text string, lang string"))
    assert {(r["detected"], r["lead"], r["n_known"]) for r in languages.detected(rows, none, "k").collect()} == {(None, None, 0)}
    assert languages.detected(rows.where("k = 9"), one, "k").count() == 0


def test_labels_that_are_no_languages(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("lang"), F.lit("abc").alias("text"))
    with pytest.raises(ValueError):
        languages.fit(rows)


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(DOCS)
    found = languages.detected(docs.where("doc_id % 5 = 0"), languages.fit(docs.where("doc_id % 5 <> 0")), "doc_id").join(docs, "doc_id")
    right, n = found.select(F.count_if(F.col("detected").eqNullSafe(F.col("lang"))), F.count(F.lit(1))).first()
    assert n == docs.where("doc_id % 5 = 0").count() and right >= 0.95 * n


def test_countries_expect_languages(spark):
    got = spark.createDataFrame([("ES",), ("ad",), ("XX",), (None,)], "c string").select(wording.expected_languages(F.col("c"))).collect()
    assert [r[0] for r in got] == [["es", "ca", "gl", "eu"], ["ca", "es", "fr"], [], []]
