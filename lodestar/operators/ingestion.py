"""A language model's claims about places into stored claims and observations, and tags that become canonical."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import kebab
from lodestar.operators import observations, reconcile
from lodestar.operators.claims import grounding

#: What a claim is unique by; claims without a review are those of the place itself.
CLAIM_KEYS = ["spot_id", "signal", "review_id"]


def grounded(excerpt: Column, cited: Column, text: Column) -> Column:
    """Whether a claim's excerpt is founded on the review that it cites; without an excerpt it is taken to be."""
    words = F.size(F.filter(F.split(F.lower(excerpt), r"[^\p{L}\p{Nd}]+"), lambda w: F.length(w) >= 4))
    blank = F.trim(F.coalesce(excerpt, F.lit(""))) == ""
    return blank | cited.isNull() | (text.isNotNull() & ((words == 0) | grounding(excerpt, text)))


def ingested(claims: DataFrame, reviews: DataFrame, stored: DataFrame, signals: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(stored claims with the new ones, observations of the new ones).

    claims: spot_id, signal, value, confidence, review_id, excerpt, seq. reviews:
    review_id, text, at, source_confidence. stored: spot_id, signal, review_id,
    value, confidence. signals: signal, value_type, a fixed list. Claims of unknown
    signals and unfounded ones go; a claim that is stored already adds nothing, so a
    second run changes nothing; of several new ones the first by seq counts.
    """
    known = claims.join(F.broadcast(signals.select("signal")), "signal", "left_semi")
    cited = known.join(reviews, "review_id", "left")
    good = cited.where(grounded(F.col("excerpt"), F.col("review_id"), F.col("text")))
    value = F.when(F.lower("value").isin("true", "false"), F.lower("value")).otherwise(F.col("value"))
    good = good.select(*CLAIM_KEYS, value.alias("value"), "confidence", "seq", "at", "source_confidence")
    columns = [*CLAIM_KEYS, "value", "confidence"]
    padded = stored.select(*columns, *[F.lit(None).cast(good.schema[c].dataType).alias(c) for c in ("seq", "at", "source_confidence")])
    every = reconcile.insert_new(padded, good, CLAIM_KEYS, [F.col("seq")])
    new = every.where("seq IS NOT NULL").select(
        F.col("seq").alias("claim_id"), F.col("spot_id").alias("entity_id"), "signal", F.col("value").alias("raw"), "confidence", "source_confidence",
        F.lit(None).cast("double").alias("reviewer_confidence"), "at", F.lit(False).alias("estimated"))
    return every.select(*columns), observations.normalize(new, signals, as_of)


def promoted(aliases: DataFrame, unknown: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases with the promoted tags, unknown tags with those marked as reviewed).

    aliases: alias, tag. unknown: alias, n, reviewed. decisions: raw, target, which
    is null where the tag stands for itself. A tag that has a meaning keeps it.
    """
    chosen = decisions.select(kebab(F.col("raw")).alias("alias"), kebab(F.coalesce("target", "raw")).alias("tag")).where("alias <> '' AND tag <> ''")
    wanted = chosen.union(chosen.select("tag", "tag")).groupBy("alias").agg(F.min("tag").alias("tag"))
    done = wanted.select("alias").withColumn("_done", F.lit(True))
    marked = unknown.join(done, "alias", "left").withColumn("reviewed", F.col("reviewed") | F.coalesce("_done", F.lit(False))).drop("_done")
    return aliases.unionByName(wanted.join(aliases, "alias", "left_anti")), marked
