"""Languages of texts by profiles of character trigrams, fitted and scored as Spark plans.

A trigram is three code points of a lower-cased word with a space before and after it;
words are runs of letters. A trigram's weight in a language is the smoothed logarithm of
its share there, in whole thousandths, so a text's score is a sum of whole numbers that
any order of rows gives alike. Trigrams outside the profiles weigh nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.session import checkpointed

#: A trigram is in the profiles if at least one in so many of some language's trigrams is it,
#: so there are at most PROFILE_SHARE trigrams a language, and the profiles can be broadcast.
PROFILE_SHARE = 20_000
#: More kinds of labels than this are no languages; `fit` raises an error then.
MOST_LANGUAGES = 256
SMOOTHING = 0.5
#: The most frequent words are summed up once, not once a text; all others go by their trigrams, with the same sums.
KNOWN_WORDS = 50_000
#: What parts words: all but letters of the basic plane.
BETWEEN = r"[^\p{L}]|[\x{10000}-\x{10FFFF}]"


@dataclass(frozen=True)
class Profiles:
    """Languages in order, and rows (_gram, _w0, _w1, ...): a weight for each language.

    words: rows (_word, _v0, _v1, ..., _known), the sums over the trigrams of frequent words.
    """

    languages: list[str]
    weights: DataFrame | None
    words: DataFrame | None = None


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")


def _grams(word: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit(" "), word, F.lit(" ")), F.lit("(?=(...))"), F.lit(1))


def fit(rows: DataFrame, text: str = "text", language: str = "lang") -> Profiles:
    """Profiles from labelled texts, all of them. Rows without a label or a text teach nothing.

    Words are counted by (language, word) and their trigrams by (language, trigram), so
    one language with most texts moves no more than its different words.
    """
    known = rows.select(F.col(language).alias("_lang"), F.col(text).alias("_text")).where("_lang IS NOT NULL AND _text IS NOT NULL")
    words = checkpointed(known.select("_lang", F.explode(_words(F.col("_text"))).alias("_word")).groupBy("_lang", "_word").agg(F.count(F.lit(1)).alias("_n")))
    counts = checkpointed(words.select("_lang", "_n", F.explode(_grams(F.col("_word"))).alias("_gram")).groupBy("_lang", "_gram").agg(F.sum("_n").alias("_n")))
    totals = {r["_lang"]: r["total"] for r in counts.groupBy("_lang").agg(F.sum("_n").alias("total")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(totals)
    if not languages:
        return Profiles([], None)
    kinds = counts.select(F.count_distinct("_gram")).first()[0]
    of = lambda i: F.coalesce(F.sum(F.when(F.col("_lang") == languages[i], F.col("_n"))), F.lit(0))
    at = range(len(languages))
    table = counts.groupBy("_gram").agg(*[of(i).alias(f"_n{i}") for i in at])
    often = F.greatest(*[F.col(f"_n{i}") * PROFILE_SHARE >= totals[languages[i]] for i in at], F.lit(False))
    weight = lambda i: F.round(F.log((F.col(f"_n{i}") + SMOOTHING) / F.lit(totals[languages[i]] + SMOOTHING * kinds)) * 1000).cast("long")
    weights = checkpointed(table.where(often).select("_gram", *[weight(i).alias(f"_w{i}") for i in at]))
    # ties at the end don't matter: a word weighs the same by its trigrams
    frequent = words.groupBy("_word").agg(F.sum("_n").alias("_n")).orderBy(F.desc("_n")).limit(KNOWN_WORDS).select("_word")
    grams = frequent.select("_word", F.explode(_grams(F.col("_word"))).alias("_gram")).join(F.broadcast(weights), "_gram", "left")
    by_word = grams.groupBy("_word").agg(*[F.coalesce(F.sum(f"_w{i}"), F.lit(0)).alias(f"_v{i}") for i in at], F.count("_w0").alias("_known"))
    return Profiles(languages, weights, checkpointed(by_word))


def detected(rows: DataFrame, profiles: Profiles, key: str, text: str = "text") -> DataFrame:
    """One row for each key: key, detected, lead (thousandths over the second language), n_known (trigrams in the profiles).

    Texts of equal key, null too, are scored as one. The language is null where no
    trigram is known; of equal scores the first language by name counts; lead is null
    with fewer than two languages. Each text is summed up in the task that reads it:
    only one row for a key and task is shuffled.
    """
    texts = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    if not profiles.languages:
        return texts.groupBy("_key").agg(F.lit(None).cast("string").alias("detected"), F.lit(None).cast("long").alias("lead"), F.lit(0).cast("long").alias("n_known")).withColumnRenamed("_key", key)
    at = range(len(profiles.languages))
    words = texts.select("_key", F.explode_outer(_words(F.col("_text"))).alias("_word")).join(F.broadcast(profiles.words), "_word", "left")
    rest = F.when(F.col("_known").isNull(), _grams(F.col("_word")))  # a known word is one row with its sums, without a trigram
    hits = words.select("*", F.explode_outer(rest).alias("_gram")).drop("_word").join(F.broadcast(profiles.weights), "_gram", "left")
    sums = hits.groupBy("_key").agg(*[F.sum(F.coalesce(f"_v{i}", f"_w{i}")).alias(f"_s{i}") for i in at],
                                    F.coalesce(F.sum(F.coalesce("_known", F.when(F.col("_w0").isNotNull(), 1))), F.lit(0)).cast("long").alias("n_known"))
    scores = F.array(*[F.struct(F.col(f"_s{i}").alias("score"), F.lit(-i).alias("order"), F.lit(profiles.languages[i]).alias("name")) for i in at])
    best = F.sort_array(scores, asc=False)
    return sums.withColumn("_best", F.when(F.col("n_known") > 0, best)).select(
        F.col("_key").alias(key), F.get("_best", 0)["name"].alias("detected"), (F.get("_best", 0)["score"] - F.get("_best", 1)["score"]).alias("lead"), "n_known")
