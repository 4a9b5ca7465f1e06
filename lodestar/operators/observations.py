"""Claims into typed observations, and the states that are lists or the latest value."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import decay
from lodestar.operators.state import at_time

#: Fixed values of the coercions.
TRUE_WORDS = ("true", "t", "yes", "y", "si", "sí", "1", "ok", "allowed", "possible")
FALSE_WORDS = ("false", "f", "no", "n", "0", "not", "forbidden", "impossible")
LEVEL_WORDS = {"low": 0.2, "bajo": 0.2, "medio": 0.5, "medium": 0.5, "alto": 0.8, "high": 0.8, "yes": 1.0, "no": 0.0}
#: Fixed values of dates, of noise sources and of parking capacity.
FUTURE_DAYS, ESTIMATED_FACTOR = 2, 0.6
LEAST_SOURCE_WEIGHT, SOURCE_HALF_LIFE = 0.2, 365
CAPACITIES, CAPACITY_DAYS = ("small", "medium", "large"), 5 * 365
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def guarded_number(raw: Column) -> Column:
    """A plain decimal number, or null; never an error, and no words such as NaN."""
    bare = F.trim(raw)
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def as_boolean(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def as_share(raw: Column) -> Column:
    """A number with point or comma, or a level's word, kept in [0, 1]."""
    words = F.create_map(*[F.lit(x) for pair in LEVEL_WORDS.items() for x in pair])
    number = F.coalesce(guarded_number(F.replace(raw, F.lit(","), F.lit("."))), F.try_element_at(words, F.lower(F.trim(raw))))
    return F.when(number.isNotNull(), _share(number))


def _share(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def partial_date(text: Column) -> Column:
    """A date of the form year-month-day or year-month, whose day is the first; else null."""
    bare = F.trim(text)
    return F.coalesce(F.try_to_timestamp(bare, F.lit("yyyy-M-d")), F.try_to_timestamp(bare, F.lit("yyyy-M"))).cast("date")


def observed_at(at: Column, as_of: Column) -> tuple[Column, Column]:
    """Time of an observation, and whether it is estimated: none and those well ahead become `as_of`."""
    unknown = at.isNull() | (at > as_of + F.expr(f"INTERVAL {FUTURE_DAYS} DAYS"))
    return F.when(unknown, as_of).otherwise(at), unknown


def normalize(claims: DataFrame, signals: DataFrame, as_of: datetime) -> DataFrame:
    """Observations of the claims whose value suits their signal's type.

    claims: claim_id, entity_id, signal, raw, confidence, source_confidence,
    reviewer_confidence, at, estimated. signals: signal, value_type, a fixed list.
    The weight is the product of the three confidences, each kept in [0, 1], where
    none or 0 of source or reviewer is 1; estimated dates weigh less.
    """
    rows = claims.join(F.broadcast(signals.select("signal", "value_type")), "signal")
    kind, raw = F.col("value_type"), F.col("raw")
    words = F.trim(raw)
    time, unknown = observed_at(F.col("at").cast("timestamp"), at_time(as_of))
    estimated = F.coalesce("estimated", F.lit(False)) | unknown
    sure = lambda c: _share(F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, 1.0).otherwise(F.col(c)))
    weight = _share(F.coalesce("confidence", F.lit(1.0))) * sure("source_confidence") * sure("reviewer_confidence")
    out = rows.select(
        "claim_id", "entity_id", "signal",
        F.when(kind == "numeric", as_share(raw)).alias("value_num"),
        F.when(kind == "boolean", as_boolean(raw)).alias("value_bool"),
        F.when((kind == "text") & (words != ""), words).alias("value_text"),
        (weight * F.when(estimated, ESTIMATED_FACTOR).otherwise(1.0)).alias("weight"),
        time.alias("observed_at"), estimated.alias("date_estimated"),
    )
    return out.where("value_num IS NOT NULL OR value_bool IS NOT NULL OR value_text IS NOT NULL")


def noise_sources(observations: DataFrame, as_of: datetime, signal: str = "noise_source") -> DataFrame:
    """Named sources of each entity whose decayed weights add up to enough, heaviest first."""
    age = decay.age_days(at_time(as_of), F.col("observed_at"))
    rows = observations.where(F.col("signal") == signal).select(
        "entity_id", F.lower(F.trim("value_text")).alias("name"), decay.half_life_decay(F.col("weight"), age, F.lit(SOURCE_HALF_LIFE)).alias("w"))
    per = rows.where("name <> ''").groupBy("entity_id", "name").agg(F.sum("w").alias("w")).where(F.col("w") >= LEAST_SOURCE_WEIGHT)
    heavy = F.array_sort(F.collect_list(F.struct((-F.round("w", 9)).alias("order"), "name")))
    return per.groupBy("entity_id").agg(F.transform(heavy, lambda x: x["name"]).alias("noise_sources"))


def parking_capacity(observations: DataFrame, as_of: datetime, signal: str = "parking_capacity") -> DataFrame:
    """The latest valid capacity of each entity within its term; of equal times the heavier one."""
    name = F.lower(F.trim("value_text"))
    age = decay.age_days(at_time(as_of), F.col("observed_at"))
    rows = observations.where((F.col("signal") == signal) & name.isin(*CAPACITIES) & (age <= CAPACITY_DAYS))
    return rows.groupBy("entity_id").agg(F.max_by(name, F.struct("observed_at", "weight", name.alias("name"))).alias("capacity"))
