"""The driver's tables as the engine's inputs, by derivations that SQL can repeat."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.tables import table

EVENTS_AS_OF, ORDERS_AS_OF = datetime(2024, 2, 1), datetime(2001, 12, 1)
EVENT_TYPES_SQL = "(SELECT DISTINCT event_type FROM events)"


def place(key: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a key, by whole-number arithmetic first."""
    return (key * 7919 % 12000) / 100.0 - 60, (key * 104729 % 36000) / 100.0 - 180


def place_sql(key: str) -> str:
    return f"CAST({key} * 7919 % 12000 AS DOUBLE) / CAST(100 AS DOUBLE) - 60 AS lat, CAST({key} * 104729 % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - 180 AS lon"


def haversine_sql(a: str, b: str) -> str:
    h = (
        f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    )
    return f"(CAST(12742.0 AS DOUBLE) * atan2(sqrt({h}), sqrt(greatest(CAST(0 AS DOUBLE), 1 - {h}))))"


def customers(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = place(F.col("c_custkey"))
    return table(spark, d, "customer").withColumn("lat", lat).withColumn("lon", lon)


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = place(F.col("s_suppkey"))
    return table(spark, d, "supplier").withColumn("lat", lat).withColumn("lon", lon)


def event_observations(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """Events, of the table or as given, as observations: the user is the entity, the type the signal, k / 100 the weight."""
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    return (table(spark, d, "events") if events is None else events).select(
        F.col("user_id").alias("entity_id"), F.col("event_type").alias("signal"), F.col("value").alias("value_num"),
        (F.col("value") > 50).alias("value_bool"), F.col("event_type").alias("value_text"),
        (F.when(k != "", k).cast("double") / 100).alias("weight"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.lit(False).alias("date_estimated"), F.col("event_id").alias("ord"),
    )


def event_signals(spark: SparkSession, d: str, value_type: str, half_life: int = 30) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("signal")).distinct().select(
        "signal", F.lit(value_type).alias("value_type"), F.lit(half_life).alias("half_life"), F.lit(1.0).alias("importance")
    )


#: The same observations in SQL, with w, the effective weight for a half-life of 30 days.
OBSERVATIONS_SQL = """
obs0 AS (
  SELECT user_id AS entity_id, event_type AS signal, value, value > 50 AS value_bool, event_id AS ord,
         CAST(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS DOUBLE) / 100 AS weight, CAST(ts AS TIMESTAMP) AS ts,
         greatest(CAST(0 AS DOUBLE), CAST(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 86400e6) AS age
  FROM events
), obs AS (
  SELECT *, weight * pow(CAST(0.5 AS DOUBLE), age / 30) * (1 + CAST(0.5 AS DOUBLE) * exp(-age / 60)) AS w FROM obs0
)"""
