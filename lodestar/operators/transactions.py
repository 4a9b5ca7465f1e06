"""A model's payloads about places into claims, observations, states, alerts, relations and spots, one epoch as one transaction."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestar.operators import ingestion, llm_payload
from lodestar.operators.reconcile import POLICIES
from lodestar.operators.state import aggregate_observations, at_time
from lodestar.operators.views import matched
from lodestar.session import checkpointed
from lodestar.sources.versioned import Kept, VersionedTables

#: The tables, each kept by its first column, the place.
TABLES = {
    "claims": "spot_id long, signal string, review_id long, value string, confidence double",
    "observations": "entity_id long, claim_id long, signal string, value_num double, value_bool boolean, value_text string, weight double, observed_at timestamp, date_estimated boolean",
    "states": "entity_id long, signal string, score_num double, score_bool boolean, score_text string, confidence double, support double, n_observations long, last_observed_at timestamp",
    "alerts": "spot_id long, alert_type string, severity double, confidence double, valid_from date, source_review_ids array<string>",
    "relations": "spot_id long, mentioned_name string, relation_type string, review_id long",
    "spots": "spot_id long, summary string, tags array<string>, active_alert_types array<string>, epoch long",
}
#: Claims of a payload are numbered below this; a payload with more is no payload of one place.
MOST_CLAIMS = 1 << 20


def store(spark: SparkSession, folder: str, buckets: int = 64) -> VersionedTables:
    """The six tables, empty where the folder is new."""
    schema = {n: StructType.fromDDL(s) for n, s in TABLES.items()}
    return VersionedTables(spark, folder, {n: Kept(s, (s.names[0],), buckets) for n, s in schema.items()}).create()


def ingest(tables: VersionedTables, epoch: int, payloads: DataFrame, reviews: DataFrame, signals: DataFrame, as_of: datetime) -> bool:
    """Everything that the payloads say, committed as `epoch`; False, and nothing done, if it stands already.

    payloads: spot_id, seq (unique), payload. reviews: review_id, text, at,
    source_confidence. signals: signal, value_type, half_life, a fixed list.
    Payloads that are no JSON or name no place change nothing; of those that are, invalid items go.

    - Claims that are known, founded and not stored already are added with their observations.
    - States of places with a payload are aggregated anew, over all their observations.
    - Alerts of a place and type become one: greatest severity and confidence, earliest start, reviews united.
    - A relation is added once for each name and kind, with the smallest review that says it.
    - The latest summary and tags that say anything stand; active alert types follow the alerts.

    Only buckets of places with a payload are read and written, so an epoch costs what
    it touches. Rows of a place meet in its bucket; large buckets are several files.
    Payloads are parsed once each, by many tasks, in however few files they came.
    """
    now = tables.snapshot()
    if epoch <= now.version:
        return False
    known = [r["signal"] for r in signals.select("signal").collect()]
    named = payloads.where("spot_id IS NOT NULL").select(F.struct(F.col("spot_id").cast("long").alias("spot_id"), "seq").alias("of"), "payload")
    spread = named.repartition(4 * tables.spark.sparkContext.defaultParallelism, "of")
    # kept before the filter, which would parse each payload again for all that it looks at
    said = checkpointed(llm_payload.validated(spread, known, key="of").select("of.spot_id", "of.seq", "claims", "alerts", "cross_references", "summary", "tags", "errors"))
    said = said.where(~F.array_contains("errors", "payload: not JSON")).drop("errors")
    touched = said.select("spot_id").distinct()
    places = tables.touched("spots", touched)
    held = {name: now.read(name, places) for name in TABLES}

    items = said.select("spot_id", "seq", F.posexplode("claims").alias("at", "c"))
    claims = items.select("spot_id", "c.signal", "c.value", "c.confidence", F.col("c.review_id").try_cast("long").alias("review_id"), "c.excerpt", (F.col("seq") * MOST_CLAIMS + F.col("at")).alias("seq"))
    stored, seen = ingestion.ingested(claims, reviews, held["claims"], signals, as_of)
    observations = checkpointed(held["observations"].unionByName(seen))

    mine = matched(observations, touched.withColumnRenamed("spot_id", "entity_id"), ["entity_id"], "left_semi").withColumn("ord", F.col("claim_id"))
    others = matched(held["states"], touched.withColumnRenamed("spot_id", "entity_id"), ["entity_id"], "left_anti")
    states = others.unionByName(aggregate_observations(mine, signals, as_of))

    warned = said.select("spot_id", F.explode("alerts").alias("a")).select(
        "spot_id", "a.alert_type", "a.severity", "a.confidence", F.coalesce(F.col("a.valid_from_inferred").try_cast("date"), at_time(as_of).cast("date")).alias("valid_from"), "a.source_review_ids")
    none = F.array().cast("array<string>")
    alerts = checkpointed(held["alerts"].unionByName(warned).groupBy("spot_id", "alert_type").agg(
        F.max("severity").alias("severity"), F.max("confidence").alias("confidence"), F.min("valid_from").alias("valid_from"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("source_review_ids", none))))).alias("source_review_ids")))
    found = said.select("spot_id", F.explode("cross_references").alias("r")).select("spot_id", "r.mentioned_name", "r.relation_type", "r.review_id")
    relations = held["relations"].unionByName(found).groupBy("spot_id", "mentioned_name", "relation_type").agg(F.min("review_id").alias("review_id"))

    told = lambda c, empty: F.max_by(c, F.when(~empty, F.col("seq"))).alias(c)
    news = said.groupBy("spot_id").agg(told("summary", F.coalesce(F.col("summary") == "", F.lit(True))), told("tags", F.size("tags") <= 0)).withColumn("epoch", F.lit(epoch).cast("long"))
    active = alerts.groupBy("spot_id").agg(F.array_sort(F.collect_set("alert_type")).alias("active_alert_types"))
    old = held["spots"].select("spot_id", *[F.col(c).alias(f"_o_{c}") for c in ("summary", "tags", "epoch")])
    spots = old.join(news, "spot_id", "full_outer").join(active, "spot_id", "left").select(
        "spot_id", *[POLICIES["take"](F.col(f"_o_{c}"), F.col(c)).alias(c) for c in ("summary", "tags")], F.coalesce("active_alert_types", none).alias("active_alert_types"),
        POLICIES["take"](F.col("_o_epoch"), F.col("epoch")).alias("epoch"))
    changed = {"claims": stored, "observations": observations, "states": states, "alerts": alerts, "relations": relations, "spots": spots}
    return tables.commit(epoch, {name: (rows, places) for name, rows in changed.items()})


def ingest_stream(payloads: DataFrame, tables: VersionedTables, reviews: DataFrame, signals: DataFrame, as_of: Callable[[int], datetime], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of a stream of payloads as one epoch, as of the time that `as_of` gives it; a batch that is run again after a failure is applied once."""
    return payloads.writeStream.foreachBatch(lambda batch, epoch: ingest(tables, epoch, batch, reviews, signals, as_of(epoch)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
