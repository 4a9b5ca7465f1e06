"""Spots merged into others, and snapshots of states that shifted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.reconcile import remap
from lodestar.operators.state import SNAPSHOT_DISTANCE


def merge_shells(spots: DataFrame, reviews: DataFrame, mapping: DataFrame) -> DataFrame:
    """Spots with shells merged: sources united, reviews counted anew, shells inactive with a note of where they went.

    spots: spot_id, sources, active, warning. reviews: spot_id, source,
    source_review_id, review_id; of reviews that both sides have one stays. mapping:
    old_id, new_id, of `merge_ends` where shells merge into shells. A shell's own claims and states go by `remap` alike.
    """
    moved = remap(reviews, mapping, "spot_id", ["spot_id", "source", "source_review_id"])
    total = moved.groupBy("spot_id").agg(F.count(F.lit(1)).alias("total_reviews"))
    gone = mapping.select(F.col("old_id").alias("spot_id"), "new_id")
    given = spots.join(gone, "spot_id").select(F.col("new_id").alias("spot_id"), F.explode("sources").alias("source"))
    given = given.groupBy("spot_id").agg(F.collect_set("source").alias("_given"))
    rows = spots.join(gone, "spot_id", "left").join(given, "spot_id", "left").join(total, "spot_id", "left")
    none = F.array().cast("array<string>")
    note = F.when(F.col("new_id").isNotNull(), F.concat(F.lit("merged into "), F.col("new_id")))
    return rows.select(
        "spot_id", F.array_sort(F.array_union("sources", F.coalesce("_given", none))).alias("sources"), (F.col("active") & F.col("new_id").isNull()).alias("active"),
        F.nullif(F.concat_ws(" | ", "warning", note), F.lit("")).alias("warning"), F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
    )


def shift_snapshots(shifts: DataFrame) -> DataFrame:
    """One row for each entity and day with a shift: the greatest distance and the latest state.

    shifts: entity_id, day, distance, state, seq.
    """
    return shifts.where(F.col("distance") > SNAPSHOT_DISTANCE).groupBy("entity_id", "day").agg(F.max("distance").alias("distance"), F.max_by("state", "seq").alias("state"))
