"""Queries over tables that change under versions: a view kept up to date, and ingestion as one transaction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.operators import llm_payload as payload_items
from lodestar.operators import transactions, views
from lodestar.plans.inputs import EVENTS_AS_OF
from lodestar.plans.text_queries import stream_folder
from lodestar.sources.tables import table
from lodestar.sources.versioned import Kept, VersionedTables

_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "cents")


def customer_orders(orders: DataFrame) -> DataFrame:
    """The view: a row for each customer with orders."""
    return orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.max("o_orderkey").alias("latest"),
                                           F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))


def order_changes(spark: SparkSession, d: str, step: int) -> DataFrame:
    """Changes of one version: first all orders but some come, then some move, rise or go, then late ones come and some go again."""
    key = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(key, F.col("o_custkey").cast("long"), "o_orderstatus", F.round(F.col("o_totalprice").cast("double") * 100).cast("long").alias("cents"))
    rows = orders.withColumn("seq", F.lit(step)).withColumn("deleted", F.lit(False))
    if step == 0:
        return rows.where(key % 7 != 0)
    if step == 1:
        moved = rows.where((key % 7 != 0) & (key % 40 == 1)).withColumn("o_custkey", F.col("o_custkey") * 3 % 1000)
        raised = rows.where((key % 7 != 0) & (key % 40 == 2)).withColumn("cents", F.col("cents") + 100)
        gone = rows.where((key % 7 != 0) & (key % 40 == 3)).withColumn("deleted", F.lit(True))
        return moved.unionByName(raised).unionByName(gone)
    late = rows.where(key % 7 == 0)
    again = rows.where((key % 7 == 0) & (key % 40 == 4)).withColumn("seq", F.lit(step + 1)).withColumn("deleted", F.lit(True))
    return late.unionByName(again)


def view_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each customer after three change sets, of which each works out only what it touches."""
    changes = order_changes(spark, d, 0)
    base = StructType([f for f in changes.schema.fields if f.name in _ORDER_COLUMNS])
    kept = {"orders": Kept(base, ("o_orderkey",), 16), "by_customer": Kept(customer_orders(changes).schema, ("o_custkey",), 16)}
    tables = VersionedTables(spark, stream_folder(spark, f"view_{uuid.uuid4().hex}"), kept).create()
    for step in range(3):
        views.maintained(tables, "orders", "by_customer", order_changes(spark, d, step), ["o_orderkey"], ["o_custkey"], customer_orders, step)
    return tables.snapshot().read("by_customer")


VIEW_MAINTENANCE = """
WITH o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 40 = 1 THEN CAST(o_custkey AS BIGINT) * 3 % 1000 ELSE o_custkey END AS o_custkey,
  CAST(round(CAST(o_totalprice AS DOUBLE) * 100) AS BIGINT) + CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 40 = 2 THEN 100 ELSE 0 END AS cents
  FROM orders WHERE NOT (o_orderkey % 7 <> 0 AND o_orderkey % 40 = 3) AND NOT (o_orderkey % 7 = 0 AND o_orderkey % 40 = 4))
SELECT o_custkey, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, max(o_orderkey) AS latest, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM o GROUP BY 1
"""

_TOLD = """SELECT conv_id AS spot_id, conv_id * 1000 + turn AS seq, turn, text, conv_id * 1000 + turn AS review_id,
  CASE turn % 3 WHEN 0 THEN 'quietness' WHEN 1 THEN 'dog_friendly' ELSE 'unheard' END AS signal, CASE WHEN turn % 3 = 0 THEN concat('0.', CAST(conv_id % 10 AS STRING)) WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END AS value,
  CASE WHEN turn % 4 = 1 THEN '' WHEN turn % 4 = 2 THEN 'entirely different statement' ELSE substr(text, 1, 40) END AS excerpt,
  CASE WHEN conv_id % 3 = 0 THEN 'theft' WHEN turn % 2 = 0 THEN 'noise' ELSE '' END AS alert_type, turn % 5 / CAST(4 AS DOUBLE) AS severity, conv_id % 11 = 0 AS broken FROM conversations"""


def _payloads(told: DataFrame) -> DataFrame:
    """Payloads as a model writes them: a claim twice, an alert that may lack its type, a relation, at times a summary."""
    claim = lambda value: F.struct("signal", value.alias("value"), F.lit(0.8).alias("confidence"), F.col("review_id").cast("string").alias("review_id"), "excerpt")
    alert = F.struct("alert_type", "severity", F.lit(0.5).alias("confidence"), F.lit("2024-01-05").alias("valid_from_inferred"), F.array(F.col("review_id").cast("string")).alias("source_review_ids"))
    related = F.struct(F.concat(F.lit("Spot "), F.col("spot_id") % 5).alias("mentioned_name"), F.when(F.col("turn") % 2 == 0, "same_complex").otherwise("unrelated").alias("relation_type"), F.col("review_id").cast("string").alias("review_id"))
    doc = F.to_json(F.struct(F.array(claim(F.col("value")), claim(F.lit("1"))).alias("claims"), F.array(alert).alias("alerts"), F.array(related).alias("cross_references"),
                             F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Turn "), "turn")).alias("summary"), F.array(F.lit("lake"), F.lit(" ")).alias("tags")))
    return told.select("spot_id", "seq", F.when(F.col("broken"), F.concat(F.lit("Sure: "), doc)).otherwise(F.concat(F.lit("```json\n"), doc, F.lit("\n```"))).alias("payload"))


def _told(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    return spark.sql(_TOLD.replace("FROM conversations", "FROM {t}"), t=turns)


def llm_payload(spark: SparkSession, d: str) -> DataFrame:
    """What holds of each payload about the conversations, and what was wrong with it."""
    payloads = _payloads(_told(spark, d)).select(F.struct("spot_id", "seq").alias("of"), "payload")
    out = payload_items.validated(payloads, ["quietness", "dog_friendly"], key="of")
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return out.select("of.spot_id", "of.seq", size("claims"), size("alerts"), size("cross_references"), F.array_join("tags", ",").alias("tags"), "summary", F.array_join("errors", "; ").alias("errors"))


LLM_PAYLOAD = f"""
SELECT spot_id, seq, CAST(CASE WHEN broken OR signal = 'unheard' THEN 0 ELSE 2 END AS BIGINT) AS n_claims, CAST(CASE WHEN broken OR alert_type = '' THEN 0 ELSE 1 END AS BIGINT) AS n_alerts,
  CAST(CASE WHEN broken OR turn % 2 <> 0 THEN 0 ELSE 1 END AS BIGINT) AS n_cross_references, CASE WHEN broken THEN '' ELSE 'lake' END AS tags, CASE WHEN NOT broken AND turn % 2 = 0 THEN 'Turn ' || turn END AS summary,
  CASE WHEN broken THEN 'payload: not JSON' ELSE concat_ws('; ', CASE WHEN signal = 'unheard' THEN 'claim: unheard; claim: unheard' END, CASE WHEN alert_type = '' THEN 'alert: ' END, CASE WHEN turn % 2 <> 0 THEN 'reference: unrelated' END) END AS errors
FROM ({_TOLD}) x
"""


def ingestion_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Spots after payloads about all conversations came as a stream, each micro-batch one transaction over six tables."""
    folder = stream_folder(spark, f"ingestion_{uuid.uuid4().hex}")
    told = _told(spark, d)
    payloads = _payloads(told)
    payloads.repartition(3, "spot_id").write.parquet(f"{folder}/payloads")  # a micro-batch for each file
    reviews = told.select("review_id", "text", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"), F.lit(0.5).alias("source_confidence"))
    signals = spark.createDataFrame([("quietness", "numeric", 30), ("dog_friendly", "boolean", 60)], "signal string, value_type string, half_life int")
    tables = transactions.store(spark, f"{folder}/tables", 16)
    stream = spark.readStream.schema(payloads.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/payloads")
    transactions.ingest_stream(stream, tables, reviews, signals, lambda epoch: EVENTS_AS_OF, f"{folder}/checkpoint").awaitTermination()
    return spots_as_stored(tables)


def spots_as_stored(tables: VersionedTables) -> DataFrame:
    """What the six tables hold of each spot, in one row; all are read as of one version."""
    now = tables.snapshot()
    count = lambda name, key, alias: now.read(name).groupBy(F.col(key).alias("spot_id")).agg(F.count(F.lit(1)).alias(alias))
    of = lambda signal, column: F.max(F.when(F.col("signal") == signal, F.col(column)))
    states = now.read("states").groupBy(F.col("entity_id").alias("spot_id")).agg(of("quietness", "score_num").alias("quietness"), of("dog_friendly", "score_bool").alias("dog_friendly"))
    alerts = now.read("alerts").groupBy("spot_id").agg(F.max("severity").alias("severity"), F.sum(F.size("source_review_ids")).alias("alert_reviews"))
    relations = now.read("relations").groupBy("spot_id").agg(F.min("review_id").alias("related_by"))
    rows = now.read("spots").drop("epoch").withColumns({"tags": F.array_join("tags", ","), "active_alert_types": F.array_join("active_alert_types", ",")})
    for part in (count("claims", "spot_id", "n_claims"), count("observations", "entity_id", "n_observations"), states, alerts, relations):
        rows = rows.join(part, "spot_id", "left")
    return rows


INGESTION_EPOCHS = rf"""
WITH t AS (SELECT * FROM ({_TOLD}) x WHERE NOT broken),
k AS (SELECT *, list_filter(string_split_regex(lower(excerpt), '[^\p{{L}}\p{{Nd}}]+'), lambda x: length(x) >= 4) AS k FROM t WHERE signal <> 'unheard'),
g AS (SELECT * FROM k WHERE trim(excerpt) = '' OR len(k) = 0 OR CAST(len(list_filter(k, lambda x: list_contains(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{Nd}}]+'), lambda y: length(y) >= 4), x))) AS DOUBLE) / len(k) >= CAST(0.34 AS DOUBLE)),
c AS (SELECT spot_id, count(*) AS n, round(avg(TRY_CAST(value AS DOUBLE)) FILTER (WHERE signal = 'quietness'), 6) AS quietness,
  count(*) FILTER (WHERE signal = 'dog_friendly' AND value = 'true') AS yes, count(*) FILTER (WHERE signal = 'dog_friendly') AS dogs FROM g
  GROUP BY 1),
a AS (SELECT spot_id, max(severity) AS severity, count(*) AS alert_reviews, string_agg(DISTINCT alert_type, ',' ORDER BY alert_type) AS kinds FROM t WHERE alert_type <> '' GROUP BY 1),
s AS (SELECT spot_id, 'Turn ' || max(turn) FILTER (WHERE turn % 2 = 0) AS summary, min(review_id) FILTER (WHERE turn % 2 = 0) AS related_by FROM t GROUP BY 1)
SELECT s.spot_id, summary, 'lake' AS tags, coalesce(kinds, '') AS active_alert_types, n AS n_claims, n AS n_observations, quietness, CASE WHEN dogs > 0 THEN 2 * yes >= dogs END AS dog_friendly, severity, alert_reviews, related_by
FROM s LEFT JOIN c USING (spot_id) LEFT JOIN a USING (spot_id)
"""

QUERIES = {"llm_payload": (llm_payload, LLM_PAYLOAD), "view_maintenance": (view_maintenance, VIEW_MAINTENANCE), "ingestion_epochs": (ingestion_epochs, INGESTION_EPOCHS)}
