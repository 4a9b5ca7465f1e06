"""Alert lifecycles, bursts of claims and the health of runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import decay
from lodestar.operators.state import at_time

#: Fixed values of alert resolution and bursts.
RESOLVE_CONFIDENCE, RESOLVE_DAYS = 0.30, 180
BURST_VALUE, BURST_DAYS, BURST_COUNT, BURST_SEVERITY, BURST_TTL_DAYS = 0.6, 7, 3, 0.7, 15


def merge_alerts(alerts: DataFrame) -> DataFrame:
    """One alert for each (spot, type): reviews united, greatest severity and confidence, earliest validity."""
    return alerts.groupBy("spot_id", "alert_type").agg(
        F.min("alert_id").alias("alert_id"), F.max("severity").alias("severity"), F.max("confidence").alias("confidence"),
        F.min("valid_from").alias("valid_from"), F.max("detected_at").alias("detected_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_review_ids")))).alias("source_review_ids"),
    )


def decay_alerts(alerts: DataFrame, as_of: datetime) -> DataFrame:
    """Unresolved alerts with decayed confidence; permanent kinds stay as they are."""
    now = at_time(as_of)
    permanent = F.col("alert_type").startswith("permanent_") | F.col("alert_type").startswith("permanently_")
    anchor = F.coalesce("last_decay_at", F.col("valid_from").cast("timestamp"), "detected_at")
    faded = F.when(permanent, F.col("confidence")).otherwise(decay.alert_confidence(F.col("confidence"), anchor, now))
    done = ~permanent & (F.col("_c") < RESOLVE_CONFIDENCE) & (F.datediff(now.cast("date"), "valid_from") >= RESOLVE_DAYS)
    rows = alerts.where("NOT resolved").withColumn("_c", faded).withColumn("resolved", F.coalesce(done, F.lit(False)))
    return rows.withColumn("confidence", F.col("_c")).withColumn("valid_until", F.when(F.col("resolved"), now.cast("date"))).withColumn("last_decay_at", now).drop("_c")


def active_types(alerts: DataFrame) -> DataFrame:
    """Sorted distinct types of each spot's unresolved alerts."""
    return alerts.where("NOT resolved").groupBy("spot_id").agg(F.array_sort(F.collect_set("alert_type")).alias("active_alert_types"))


def bursts(claims: DataFrame, signals: list[str], as_of: datetime) -> DataFrame:
    """(entity, signal) with BURST_COUNT strong claims or more in the last BURST_DAYS."""
    now = at_time(as_of)
    recent = claims.where(
        F.col("signal").isin(signals) & (F.col("value") > BURST_VALUE) & (F.col("created_at") >= now - F.expr(f"INTERVAL {BURST_DAYS} DAYS")) & (F.col("created_at") <= now)
    )
    return recent.groupBy("entity_id", "signal").agg(
        F.count(F.lit(1)).alias("n_claims"), F.greatest(F.lit(BURST_SEVERITY), F.avg("confidence")).alias("severity"), F.min("created_at").alias("first_seen")
    ).where(F.col("n_claims") >= BURST_COUNT).withColumn("expires_at", now + F.expr(f"INTERVAL {BURST_TTL_DAYS} DAYS"))


def health_light(status: Column, ended_at: Column, errors: Column, total: Column, as_of: datetime, started_at: Column | None = None) -> Column:
    """red, amber or green for a run, by its status, its age in whole days and its share of errors."""
    started = ended_at if started_at is None else started_at
    hours = (F.unix_micros(at_time(as_of)) - F.unix_micros(started.cast("timestamp"))) / 3600e6
    days = F.floor((F.unix_micros(at_time(as_of)) - F.unix_micros(ended_at.cast("timestamp"))) / (decay.DAY_SECONDS * 1e6))
    share = F.when(total > 0, errors / total).otherwise(F.when(errors > 0, 1.0).otherwise(0.0))
    return (
        F.when(started.isNull(), "red")
        .when((status == "running") & (hours > 6), "red").when(status == "running", "amber")
        .when(status.isin("zombie", "error"), "red")
        .when((status == "ok_with_errors") & ((days > 60) | (errors > 1000) | (share > 0.30)), "red").when(status == "ok_with_errors", "amber")
        .when((share > 0.20) | (days > 60), "red").when((share > 0.05) | (days > 14), "amber").otherwise("green")
    )
