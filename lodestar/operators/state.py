"""Observations into state: decayed aggregation, regime change, distance, staleness."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import decay

#: Fixed values of regime change and snapshots.
RECENT_DAYS, LEAST_CLUSTER, LEAST_GAP_DAYS, LEAST_CHANGE = 180, 3, 90, 0.4
SNAPSHOT_DISTANCE = 0.15


def at_time(as_of: datetime) -> Column:
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp")


def weighted(observations: DataFrame, signals: DataFrame, as_of: datetime) -> DataFrame:
    """Observations of known signals with w, their effective weight; those of 0 or less are left out."""
    rows = observations.join(signals, "signal")  # a small registry, which Spark broadcasts by its size
    w = decay.effective_weight(F.col("weight"), F.col("observed_at"), at_time(as_of), F.col("half_life"), F.col("date_estimated"))
    return rows.withColumn("w", w)


def reopened(observations: DataFrame, closure: str) -> DataFrame:
    """Entities whose closure is older than a later observation of any other signal, by certain dates."""
    certain = ~F.coalesce(F.col("date_estimated"), F.lit(False))
    closed = (F.col("signal") == closure) & F.col("value_bool")
    latest = observations.groupBy("entity_id").agg(
        F.max(F.when(certain & closed, F.col("observed_at"))).alias("closed_at"),
        F.max(F.when(certain & (F.col("signal") != closure), F.col("observed_at"))).alias("other_at"),
    )
    return latest.where("other_at > closed_at").select("entity_id")


def aggregate_observations(observations: DataFrame, signals: DataFrame, as_of: datetime, closure: str = "spot_closed") -> DataFrame:
    """One row for each (entity, signal): score by the signal's type, confidence, support and count.

    observations: entity_id, signal, value_num, value_bool, value_text, weight,
    observed_at, date_estimated, ord. signals: signal, value_type, half_life.
    Numeric means divide by all support, also that of rows without a number; null
    booleans count as false; equal text weights go to the smaller first ord.
    """
    alive = observations.join(reopened(observations, closure).withColumn("signal", F.lit(closure)), ["entity_id", "signal"], "left_anti")
    rows = weighted(alive, signals, as_of)
    positive = F.greatest(F.col("w"), F.lit(0.0))
    yes = F.coalesce(F.col("value_bool"), F.lit(False))
    keys = ["entity_id", "signal", "value_type"]
    main = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.sum(positive).alias("support"),
        F.sum(F.when(yes, positive).otherwise(0.0)).alias("t"),
        F.sum(F.when(~yes, positive).otherwise(0.0)).alias("f"),
        F.sum(F.col("value_num") * positive).alias("weighted_sum"),
        F.count("value_num").alias("numbers"),
        F.max("observed_at").alias("last_observed_at"),
    ).where("support > 0")
    texts = rows.where("value_type = 'text' AND value_text <> '' AND w > 0").groupBy(*keys, "value_text").agg(
        F.sum("w").alias("tw"), F.min("ord").alias("first_ord")
    )
    mode = texts.groupBy(*keys).agg(F.max_by(F.struct("value_text", "tw"), F.struct("tw", -F.col("first_ord"))).alias("mode"))
    out = main.join(mode, keys, "left")
    kind = F.col("value_type")
    confidence = (
        F.when(kind == "boolean", decay.boolean_confidence(F.col("t"), F.col("f")))
        .when(kind == "numeric", decay.numeric_confidence(F.col("support")))
        .otherwise(F.col("mode.tw") / F.col("support"))
    )
    return out.where((kind == "boolean") | ((kind == "numeric") & (F.col("numbers") > 0)) | ((kind == "text") & F.col("mode").isNotNull())).select(
        "entity_id", "signal",
        F.when(kind == "numeric", F.round(F.col("weighted_sum") / F.col("support"), 6)).alias("score_num"),
        F.when(kind == "boolean", F.col("t") >= F.col("f")).alias("score_bool"),
        F.when(kind == "text", F.col("mode.value_text")).alias("score_text"),
        F.round(confidence, 6).alias("confidence"),
        F.round("support", 6).alias("support"),
        "n_observations", "last_observed_at",
    )


def entity_summary(observations: DataFrame, signals: DataFrame, as_of: datetime) -> DataFrame:
    """For each entity: observations with weight, their support and the consensus."""
    rows = weighted(observations, signals, as_of).where("w > 0")
    return rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("total_observations"), F.sum("w").alias("s")).select(
        "entity_id", "total_observations", F.round("s", 6).alias("weight_support"), F.round(decay.consensus(F.col("s")), 6).alias("consensus")
    )


def regime_change(observations: DataFrame, as_of: datetime) -> DataFrame:
    """(entity, signal) whose recent weighted mean left the older one, in one conditional aggregation.

    observations: entity_id, signal, value (numbers, booleans as 0 or 1), weight, observed_at.
    """
    now = at_time(as_of)
    recent = decay.age_days(now, F.col("observed_at")) <= RECENT_DAYS
    when = lambda c, v: F.when(c, v)
    rows = observations.where("value IS NOT NULL").groupBy("entity_id", "signal").agg(
        F.count(when(recent, 1)).alias("n_new"),
        F.count(when(~recent, 1)).alias("n_old"),
        F.sum(when(recent, F.col("value") * F.col("weight"))).alias("vn"),
        F.sum(when(recent, F.col("weight"))).alias("wn"),
        F.sum(when(~recent, F.col("value") * F.col("weight"))).alias("vo"),
        F.sum(when(~recent, F.col("weight"))).alias("wo"),
        F.min(when(recent, F.col("observed_at"))).alias("since"),
        F.max(when(~recent, F.col("observed_at"))).alias("last_old"),
    )
    gap = (F.unix_micros("since") - F.unix_micros("last_old")) / (decay.DAY_SECONDS * 1e6)
    new, old = F.col("vn") / F.col("wn"), F.col("vo") / F.col("wo")
    enough = (F.col("n_new") >= LEAST_CLUSTER) & (F.col("n_old") >= LEAST_CLUSTER) & (gap >= LEAST_GAP_DAYS) & (F.col("wn") > 0) & (F.col("wo") > 0)
    return rows.where(enough).where(F.abs(new - old) > LEAST_CHANGE).select(
        "entity_id", "signal", F.round(old, 4).alias("old_mean"), F.round(new, 4).alias("new_mean"),
        F.round(new - old, 4).alias("delta"), "n_old", "n_new", "since",
    )


def signal_distance(before: DataFrame, after: DataFrame, signals: DataFrame) -> DataFrame:
    """Sum over signals that both states have of |change| * importance, for each entity."""
    joined = before.select("entity_id", "signal", F.col("score").alias("old")).join(
        after.select("entity_id", "signal", F.col("score").alias("new")), ["entity_id", "signal"]
    ).join(signals.select("signal", "importance"), "signal", "left")
    change = F.abs(F.col("new") - F.col("old")) * F.coalesce("importance", F.lit(1.0))
    return joined.groupBy("entity_id").agg(F.sum(change).alias("d")).select(
        "entity_id", F.round("d", 8).alias("distance"), (F.col("d") > SNAPSHOT_DISTANCE).alias("snapshot")
    )


def needs_recompute(as_of: datetime) -> Column:
    """Whether the least half-life of a state's signals has passed since it was aggregated."""
    days = (F.unix_micros(at_time(as_of)) - F.unix_micros("last_aggregated_at")) / (decay.DAY_SECONDS * 1e6)
    return F.coalesce(days > F.col("least_half_life"), F.lit(False))


def stale_entities(states: DataFrame, observations: DataFrame) -> DataFrame:
    """Entities with an observation that is later than their state."""
    latest = observations.groupBy("entity_id").agg(F.max("observed_at").alias("seen_at"))
    return states.join(latest, "entity_id").where("seen_at > last_aggregated_at").select("entity_id", "seen_at")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")
