"""Weights and confidences that fade with age. Every function takes the time it is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400.0
#: Fixed values of the weighting rules.
BOOST, BOOST_DAYS = 0.5, 60.0
FULL_BOOLEAN_SUPPORT, FULL_NUMERIC_SUPPORT, FULL_CONSENSUS = 3.0, 5.0, 12.0
ALERT_MONTHLY, DAYS_PER_MONTH = 0.85, 30.44
ACTIVE_CONFIDENCE = 0.5


def age_days(as_of: Column, at: Column) -> Column:
    """Fractional days from `at` to `as_of`, not below 0."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.greatest(F.lit(0.0), micros / F.lit(DAY_SECONDS * 1e6))


def half_life_decay(weight: Column, age: Column, half_life: Column) -> Column:
    """weight * 0.5 ** (age / half_life); no decay for a half-life of 0 or less."""
    return F.when(half_life <= 0, weight).otherwise(weight * F.pow(F.lit(0.5), age / half_life))


def recency_boost(age: Column) -> Column:
    return 1.0 + BOOST * F.exp(-age / BOOST_DAYS)


def effective_weight(weight: Column, at: Column, as_of: Column, half_life: Column, estimated: Column) -> Column:
    """Decayed weight, boosted if recent unless the date is estimated or to come."""
    age = age_days(as_of, at)
    plain = half_life_decay(weight, age, half_life)
    unsure = F.coalesce(estimated, F.lit(False)) | (at > as_of)
    return F.when(unsure, plain).otherwise(plain * recency_boost(age))


def boolean_confidence(true_weight: Column, false_weight: Column) -> Column:
    support = true_weight + false_weight
    share = F.abs(true_weight - false_weight) / support * F.least(F.lit(1.0), support / FULL_BOOLEAN_SUPPORT)
    return F.when(support > 0, share).otherwise(0.0)


def numeric_confidence(support: Column) -> Column:
    return F.least(F.lit(1.0), support / FULL_NUMERIC_SUPPORT)


def consensus(support: Column) -> Column:
    """1 from a support of 12 on, logarithmic below."""
    return F.least(F.lit(1.0), F.ln(1.0 + support) / F.ln(F.lit(1.0 + FULL_CONSENSUS)))


def alert_confidence(confidence: Column, anchor: Column, as_of: Column) -> Column:
    """Monthly decay since the anchor, rounded to cents and kept in [0, 1]."""
    months = age_days(as_of, anchor) / DAYS_PER_MONTH
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence * F.pow(F.lit(ALERT_MONTHLY), months))), 2)


def lifecycle_state(confidence: Column, resolved: Column) -> Column:
    return F.when(resolved, "likely_resolved").when(confidence < ACTIVE_CONFIDENCE, "decaying").otherwise("active")


def lifecycle_weight(state: Column) -> Column:
    return F.when(state == "active", 1.0).when(state == "decaying", 0.5).otherwise(0.0)


def review_age_weight(at: Column, as_of: Column) -> Column:
    """Steps by whole days of age; 0.3 without a date, 1 for dates to come."""
    days = F.datediff(as_of, at)
    return (
        F.when(at.isNull(), 0.3).when(days < 365, 1.0).when(days < 730, 0.8).when(days < 1095, 0.5).when(days < 1825, 0.3).otherwise(0.1)
    )
