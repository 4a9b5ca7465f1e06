"""Places with all that hangs on them, as one nested row each."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.state import at_time

#: Fixed value: how many of a place's latest reviews are shown.
MOST_REVIEWS = 20
_NO_KEY = "spot_id IS NOT NULL"


def _child(rows: DataFrame, kind: str, order: list[Column]) -> DataFrame:
    """Rows (spot_id, kind): a struct of what orders the item among its like, ascending, and the item."""
    keys = [c.alias(f"_{i}") for i, c in enumerate(order)]
    item = F.struct(*[F.col(c) for c in rows.columns if c != "spot_id"])
    return rows.where(_NO_KEY).select("spot_id", F.struct(*keys, item.alias("item")).alias(kind))


def _latest(time: Column) -> list[Column]:
    """Ascending keys for the latest first and those without a time last."""
    return [time.isNull(), -F.unix_micros(time.cast("timestamp"))]


def spot_details(spots: DataFrame, sources: DataFrame, reviews: DataFrame, overrides: DataFrame, provenance: DataFrame, states: DataFrame, enrichments: DataFrame, geo: DataFrame, as_of: datetime, most_reviews: int = MOST_REVIEWS) -> DataFrame:
    """Every spot's columns, and sources, reviews, field_overrides, provenance, enrichment, enrichment_source, geo.

    All inputs have spot_id; their other columns become the items, so extra columns ride along.
    - sources: source; in the order of source.
    - reviews: review_id, date; the latest `most_reviews`, those without a date last, ties by review_id.
    - overrides: field, expires_at; those that still hold at `as_of`, the last to end first, ties by field.
    - provenance: field, conflict, confidence; conflicts first, then the least sure, unknown confidence last.
    - states, and where a spot has none, enrichments: columns of one list; enrichment_source says which
      ("state", "enrichment" or null). geo: one row. Of several rows of a spot the least in column order counts.
    Items are of types that can be ordered. A list without items is empty; a row of no spot is left out.

    Reviews are cut to the latest of each spot in the tasks that read them, before they
    are shuffled, so a spot with a third of all reviews moves `most_reviews` a task. Then all kinds of
    children meet in one shuffle.
    """
    newest = Window.partitionBy("spot_id").orderBy(*_latest(F.col("date")), "review_id")
    shown = reviews.where(_NO_KEY).withColumn("_at", F.row_number().over(newest)).where(F.col("_at") <= most_reviews).drop("_at")
    live = overrides.where(F.col("expires_at").cast("timestamp") > at_time(as_of))
    sure = F.col("confidence")
    every = [
        _child(sources, "sources", [F.col("source")]), _child(shown, "reviews", [*_latest(F.col("date")), F.col("review_id")]),
        _child(live, "field_overrides", [*_latest(F.col("expires_at")), F.col("field")]),
        _child(provenance, "provenance", [~F.coalesce("conflict", F.lit(False)), sure.isNull(), sure, F.col("field")]),
        _child(states, "_state", []), _child(enrichments, "_enrichment", []), _child(geo, "geo", []),
    ]
    lists, ones = ("sources", "reviews", "field_overrides", "provenance"), ("_state", "_enrichment", "geo")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)
    hung = rows.groupBy("spot_id").agg(*[F.array_sort(F.collect_list(k)).alias(k) for k in lists], *[F.min(k)["item"].alias(k) for k in ones])
    items = lambda k: F.coalesce(F.transform(k, lambda x: x["item"]), F.array().cast(hung.select(F.transform(k, lambda x: x["item"])).schema[0].dataType)).alias(k)
    return spots.join(hung, "spot_id", "left").select(
        *[spots[c] if c != "spot_id" else F.col(c) for c in spots.columns], *[items(k) for k in lists],
        F.coalesce("_state", "_enrichment").alias("enrichment"), F.when(F.col("_state").isNotNull(), "state").when(F.col("_enrichment").isNotNull(), "enrichment").alias("enrichment_source"), hung["geo"])
