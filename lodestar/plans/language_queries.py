"""Queries over languages of texts: profiles of trigrams, then what the country expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text, wording
from lodestar.operators import languages
from lodestar.sources.tables import table

#: Countries that documents are given in turn; one has no expected language.
COUNTRIES = ("ES", "ad", "PT", "IT", "FR", "XX", "CH")


def language_detection(spark: SparkSession, d: str) -> DataFrame:
    """Languages of all documents, learned from four of five of them: by trigrams, by words where none is known, then by the country."""
    docs = table(spark, d, "documents")
    found = languages.detected(docs, languages.fit(docs.where("doc_id % 5 <> 0")), "doc_id")
    country = F.element_at(F.array(*map(F.lit, COUNTRIES)), (F.col("doc_id") % len(COUNTRIES) + 1).cast("int"))
    start = F.substring("text", 1, wording.CONFUSED_CHARS)  # all that the rule of short texts looks at, so whole texts don't move
    rows = docs.select("doc_id", "lang", start.alias("start"), text.keyword_language(F.col("text")).alias("by_words")).join(found, "doc_id")
    return rows.select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), "lang", "detected", "lead", "n_known",
                       wording.language_with_prior(F.coalesce("detected", "by_words"), F.col("start"), wording.expected_languages(country)).alias("language"))


def _quoted(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


LANGUAGE_DETECTION = rf"""
WITH w AS (SELECT doc_id, lang, ' ' || unnest(string_split_regex(lower(text), '[^\p{{L}}]|[\x{{10000}}-\x{{10FFFF}}]')) || ' ' AS w FROM documents),
p AS (SELECT doc_id, lang, w, unnest(range(1, length(w) - 1)) AS i FROM w WHERE length(w) > 2),
g AS (SELECT doc_id, lang, substr(w, i, 3) AS gram, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT lang, gram, sum(n) AS n FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY ALL),
t AS (SELECT lang, sum(n) AS total FROM c GROUP BY 1),
k AS (SELECT DISTINCT gram FROM c JOIN t USING (lang) WHERE n * {languages.PROFILE_SHARE} >= total),
v AS (SELECT count(DISTINCT gram) AS kinds FROM c),
m AS (SELECT t.lang, k.gram, CAST(round(ln((CAST(coalesce(c.n, 0) AS DOUBLE) + 0.5) / (CAST(total AS DOUBLE) + CAST(0.5 AS DOUBLE) * kinds)) * 1000) AS BIGINT) AS weight
  FROM k CROSS JOIN t CROSS JOIN v LEFT JOIN c ON c.lang = t.lang AND c.gram = k.gram),
s AS (SELECT doc_id, m.lang AS name, sum(n * weight) AS score, sum(n) AS n_known FROM g JOIN m USING (gram) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) AS rn FROM s),
b AS (SELECT doc_id, max(name) FILTER (WHERE rn = 1) AS detected, max(score) FILTER (WHERE rn = 1) - max(score) FILTER (WHERE rn = 2) AS lead, max(n_known) AS n_known FROM r GROUP BY 1),
e(country, expected) AS (VALUES {', '.join(f"('{c}', [{_quoted(ls)}])" for c, ls in wording.COUNTRY_LANGUAGES.items())}),
f(a, b, meant) AS (VALUES {', '.join(f"('{a}', '{b}', '{x}')" for (a, b), x in wording.CONFUSIONS.items())})
SELECT d.doc_id, d.doc_id % 5 = 0 AS held_out, d.lang, detected, CAST(lead AS BIGINT) AS lead, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known,
  CASE WHEN length(text) < {wording.CONFUSED_CHARS} AND NOT list_contains(expected, detected) THEN coalesce(meant, detected) ELSE detected END AS language
FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN e ON e.country = upper([{_quoted(COUNTRIES)}][d.doc_id % {len(COUNTRIES)} + 1]) LEFT JOIN f ON f.a = detected AND f.b = expected[1]
"""

QUERIES = {"language_detection": (language_detection, LANGUAGE_DETECTION)}
