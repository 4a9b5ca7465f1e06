"""Incremental state: decayed sums of each (entity, signal), kept over micro-batches.

A weight that halves every `half_life` days can be summed at one fixed time and
rescaled to any other, so sums at a reference time add up in any order and batches
may be late or repeated in time: the state equals a batch aggregation.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.functions.decay import DAY_SECONDS
from lodestar.operators.state import at_time


def decayed_sums(observations: DataFrame, half_life: float, reference: datetime) -> DataFrame:
    """Rows (entity_id, signal, support, weighted_sum, n): sums of weights as of the reference time."""
    days = (F.unix_micros(at_time(reference)) - F.unix_micros("observed_at")) / (DAY_SECONDS * 1e6)
    w = F.col("weight") * F.pow(F.lit(0.5), days / half_life)
    return observations.groupBy("entity_id", "signal").agg(
        F.sum(w).alias("support"), F.sum(F.col("value_num") * w).alias("weighted_sum"), F.count(F.lit(1)).alias("n"))


def merged_sums(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two states as one."""
    return old.unionByName(new).groupBy("entity_id", "signal").agg(F.sum("support").alias("support"), F.sum("weighted_sum").alias("weighted_sum"), F.sum("n").alias("n"))


def scores(state: DataFrame) -> DataFrame:
    return state.where("support > 0").select("entity_id", "signal", F.round(F.col("weighted_sum") / F.col("support"), 6).alias("score"), "n")


def stream_scores(observations: DataFrame, half_life: float, reference: datetime) -> DataFrame:
    """The same scores over a stream: a stateful aggregation that updates as observations arrive."""
    return scores(decayed_sums(observations, half_life, reference))


def burst_counts(claims: DataFrame, days: int = 7, late: str = "2 days") -> DataFrame:
    """Counts of each (entity, signal) in sliding windows of `days`, a day apart; later than `late` is left out."""
    return claims.withWatermark("created_at", late).groupBy(F.window("created_at", f"{days} days", "1 day"), "entity_id", "signal").agg(F.count(F.lit(1)).alias("n_claims"))


def run_once(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run what the stream has to its end and return the latest row of each key.

    Each batch appends the rows that it changed to a table in the shared `folder`,
    so no state goes through the driver; a batch that is run again replaces its own.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/table")
    columns = [c for c in stream.columns if c not in keys]
    latest = F.max_by(F.struct(*columns), "batch").alias("x")
    return rows.groupBy(*keys).agg(latest).select(*keys, "x.*")
