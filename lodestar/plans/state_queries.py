"""Queries on observations, states, alerts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import decay
from lodestar.operators import alerts, reconcile, state
from lodestar.plans.inputs import EVENTS_AS_OF, OBSERVATIONS_SQL, ORDERS_AS_OF, event_observations, event_signals
from lodestar.sources.tables import table


def decay_state(spark: SparkSession, d: str) -> DataFrame:
    out = state.aggregate_observations(event_observations(spark, d), event_signals(spark, d, "numeric"), EVENTS_AS_OF)
    return out.select("entity_id", "signal", F.col("score_num").alias("score"), "confidence",
                      "support", "n_observations")


DECAY_STATE = f"""
WITH {OBSERVATIONS_SQL}
SELECT entity_id, signal, round(sum(value * w) / sum(w), 6) AS score, round(least(1, sum(w) / 5), 6) AS confidence,
       round(sum(w), 6) AS support, count(*) AS n_observations
FROM obs GROUP BY entity_id, signal HAVING sum(w) > 0
"""


def boolean_consensus(spark: SparkSession, d: str) -> DataFrame:
    obs, signals = event_observations(spark, d), event_signals(spark, d, "boolean")
    out = state.aggregate_observations(obs, signals, EVENTS_AS_OF)
    whole = state.entity_summary(obs, signals, EVENTS_AS_OF)
    return out.join(whole, "entity_id").select(
        "entity_id", "signal", "score_bool", "confidence", "consensus", "total_observations")


BOOLEAN_CONSENSUS = f"""
WITH {OBSERVATIONS_SQL}, s AS (
  SELECT entity_id, signal, sum(w) AS sw, coalesce(sum(w) FILTER (WHERE value_bool), 0) AS t, coalesce(sum(w) FILTER (WHERE NOT value_bool), 0) AS f
  FROM obs GROUP BY entity_id, signal HAVING sum(w) > 0
), e AS (
  SELECT entity_id, sum(w) AS w, count(*) FILTER (WHERE w > 0) AS total_observations FROM obs WHERE w > 0 GROUP BY entity_id
)
SELECT s.entity_id, signal, t >= f AS score_bool, round(abs(t - f) / (t + f) * least(1, (t + f) / 3), 6) AS confidence,
       round(least(1, ln(1 + w) / ln(CAST(13 AS DOUBLE))), 6) AS consensus, total_observations
FROM s JOIN e USING (entity_id)
"""


def text_mode(spark: SparkSession, d: str) -> DataFrame:
    obs = event_observations(spark, d).withColumn("signal", F.lit("dominant"))
    signals = spark.range(1).select(F.lit("dominant").alias("signal"), F.lit("text").alias("value_type"), F.lit(30).alias("half_life"))
    return state.aggregate_observations(obs, signals, EVENTS_AS_OF).select("entity_id", "score_text", "confidence", "n_observations")


TEXT_MODE = f"""
WITH {OBSERVATIONS_SQL}, t AS (
  SELECT entity_id, signal, sum(w) AS w, min(ord) AS first_ord FROM obs WHERE w > 0 GROUP BY entity_id, signal
), r AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY w DESC, first_ord) AS rn, sum(w) OVER (PARTITION BY entity_id) AS total FROM t
), n AS (SELECT entity_id, count(*) AS n_observations FROM obs GROUP BY entity_id)
SELECT r.entity_id, signal AS score_text, round(w / total, 6) AS confidence, n_observations FROM r JOIN n USING (entity_id) WHERE rn = 1
"""


def regime_change(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.lit("price").alias("signal"), (F.col("o_totalprice") / 100000.0).alias("value"),
        F.lit(1.0).alias("weight"), F.col("o_orderdate").cast("timestamp").alias("observed_at"))
    found = state.regime_change(rows.withColumn("observed_at", F.expr("observed_at + make_interval(0, 0, 0, 120)")), ORDERS_AS_OF)
    return found.select("entity_id", "old_mean", "new_mean", "delta", "n_old", "n_new", "since")


REGIME_CHANGE = """
WITH o AS (
  SELECT o_custkey AS entity_id, o_totalprice / CAST(100000 AS DOUBLE) AS v, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 120 DAY AS seen FROM orders
), c AS (
  SELECT *, greatest(0, CAST(epoch_us(TIMESTAMP '2001-12-01') - epoch_us(seen) AS DOUBLE) / 86400e6) <= 180 AS recent FROM o
), g AS (
  SELECT entity_id, count(*) FILTER (WHERE recent) AS n_new, count(*) FILTER (WHERE NOT recent) AS n_old,
         avg(v) FILTER (WHERE recent) AS nm, avg(v) FILTER (WHERE NOT recent) AS om,
         min(seen) FILTER (WHERE recent) AS since, max(seen) FILTER (WHERE NOT recent) AS last_old
  FROM c GROUP BY entity_id
)
SELECT entity_id, round(om, 4) AS old_mean, round(nm, 4) AS new_mean, round(nm - om, 4) AS delta, n_old, n_new, since
FROM g WHERE n_new >= 3 AND n_old >= 3 AND epoch_us(since) - epoch_us(last_old) >= 90 * 86400e6 AND abs(nm - om) > CAST(0.4 AS DOUBLE)
"""


def signal_distance(spark: SparkSession, d: str) -> DataFrame:
    obs = event_observations(spark, d)
    middle = F.lit("2024-01-16").cast("timestamp")
    mean = lambda rows: rows.groupBy("entity_id", "signal").agg((F.avg("value_num") / 100).alias("score"))
    out = state.signal_distance(mean(obs.where(F.col("observed_at") < middle)), mean(obs.where(F.col("observed_at") >= middle)), event_signals(spark, d, "numeric"))
    return out.select("entity_id", "distance", "snapshot")


SIGNAL_DISTANCE = """
WITH m AS (
  SELECT user_id AS entity_id, event_type, ts < TIMESTAMP '2024-01-16' AS before, avg(value) / 100 AS score FROM events GROUP BY ALL
), x AS (
  SELECT a.entity_id, sum(abs(b.score - a.score)) AS d FROM m a JOIN m b ON a.entity_id = b.entity_id AND a.event_type = b.event_type AND a.before AND NOT b.before
  GROUP BY a.entity_id
)
SELECT entity_id, round(d, 8) AS distance, d > CAST(0.15 AS DOUBLE) AS snapshot FROM x
"""


def closure_reopen(spark: SparkSession, d: str) -> DataFrame:
    obs = event_observations(spark, d)
    return state.reopened(obs, "error")


CLOSURE_REOPEN = """
SELECT user_id AS entity_id FROM events GROUP BY user_id
HAVING max(ts) FILTER (WHERE event_type <> 'error') > max(ts) FILTER (WHERE event_type = 'error' AND value > 50)
"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    """A state for each user, aggregated at the middle of the user's event ids."""
    return event_observations(spark, d).groupBy("entity_id").agg(
        F.max(F.when(F.col("ord") % 2 == 0, F.col("observed_at"))).alias("last_aggregated_at"), F.min(F.length("signal")).alias("least_half_life"))


STATES_SQL = "SELECT user_id AS entity_id, max(ts) FILTER (WHERE event_id % 2 = 0) AS last_aggregated_at, min(length(event_type)) AS least_half_life FROM events GROUP BY user_id"


def needs_recompute(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select("entity_id", state.needs_recompute(EVENTS_AS_OF).alias("recompute"))


NEEDS_RECOMPUTE = f"""
SELECT entity_id, coalesce(CAST(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_aggregated_at) AS DOUBLE) / 86400e6 > least_half_life, false) AS recompute
FROM ({STATES_SQL})
"""


def stale_keys(spark: SparkSession, d: str) -> DataFrame:
    return state.stale_entities(_states(spark, d), event_observations(spark, d)).select("entity_id", "seen_at")


STALE_KEYS = f"""
SELECT s.entity_id, max(ts) AS seen_at FROM ({STATES_SQL}) s JOIN events e ON e.user_id = s.entity_id
GROUP BY s.entity_id, last_aggregated_at HAVING max(ts) > last_aggregated_at
"""


def latest_run(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return state.latest_per_key(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")])


LATEST_RUN = """
SELECT user_id, event_id, event_type, value, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
"""


def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return state.latest_per_key(rows, ["l_partkey", "l_suppkey"], [F.desc("l_orderkey"), F.desc("l_linenumber")])


DEDUP_LATEST = """
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1
"""


def health_light(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ended_at"),
        F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("total"))
    status = F.when(F.col("status") == "error", "error").when(F.col("status") == "view", "ok_with_errors").otherwise("ok")
    light = alerts.health_light(status, F.col("ended_at"), F.col("errors"), F.col("total"), EVENTS_AS_OF)
    return rows.select("user_id", "errors", "total", light.alias("light"))


HEALTH_LIGHT = """
WITH g AS (
  SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS total,
         floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 86400e6) AS days
  FROM events GROUP BY user_id
), p AS (SELECT *, CAST(errors AS DOUBLE) / total AS pct FROM g)
SELECT user_id, errors, total, CASE
  WHEN status = 'error' THEN 'red'
  WHEN status = 'view' AND days > 60 THEN 'red'
  WHEN status = 'view' AND (errors > 1000 OR pct > CAST(0.3 AS DOUBLE)) THEN 'red'
  WHEN status = 'view' THEN 'amber'
  WHEN pct > CAST(0.2 AS DOUBLE) THEN 'red' WHEN days > 60 THEN 'red' WHEN pct > CAST(0.05 AS DOUBLE) THEN 'amber' WHEN days > 14 THEN 'amber' ELSE 'green' END AS light
FROM p
"""


def _alert_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("alert_id"), F.col("o_custkey").alias("spot_id"), F.col("o_orderpriority").alias("alert_type"),
        ((F.col("o_orderkey") % 100) / 100).alias("confidence"), F.col("o_orderdate").cast("date").alias("valid_from"),
        F.col("o_orderdate").cast("timestamp").alias("detected_at"), F.lit(None).cast("timestamp").alias("last_decay_at"), F.lit(False).alias("resolved"))


def alert_decay(spark: SparkSession, d: str) -> DataFrame:
    return alerts.decay_alerts(_alert_rows(spark, d), ORDERS_AS_OF).select("alert_id", F.round("confidence", 2).alias("confidence"), "resolved", F.col("valid_until").cast("string").alias("valid_until"))


ALERT_DECAY = """
WITH a AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS f, least(1, greatest(0, CAST(o_orderkey % 100 AS DOUBLE) / 100 * pow(CAST(0.85 AS DOUBLE),
    greatest(0, CAST(epoch_us(TIMESTAMP '2001-12-01') - epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS DOUBLE) / 86400e6) / CAST(30.44 AS DOUBLE)))) AS c FROM orders
), b AS (SELECT *, round(c, 2) < CAST(0.3 AS DOUBLE) AND date_diff('day', f, DATE '2001-12-01') >= 180 AS done FROM a)
SELECT o_orderkey AS alert_id, round(c, 2) AS confidence, done AS resolved, CASE WHEN done THEN '2001-12-01' END AS valid_until FROM b
"""


def alert_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    rows = _alert_rows(spark, d).withColumn("resolved", F.col("alert_id") % 7 == 0)
    s = decay.lifecycle_state(F.col("confidence"), F.col("resolved"))
    return rows.groupBy("alert_type", s.alias("lifecycle")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(decay.lifecycle_weight(s)), 2).alias("weight"))


ALERT_LIFECYCLE = """
WITH a AS (
  SELECT o_orderpriority AS alert_type, CASE WHEN o_orderkey % 7 = 0 THEN 'likely_resolved' WHEN o_orderkey % 100 < 50 THEN 'decaying' ELSE 'active' END AS lifecycle FROM orders)
SELECT alert_type, lifecycle, count(*) AS n, round(sum(CASE lifecycle WHEN 'active' THEN CAST(1 AS DOUBLE) WHEN 'decaying' THEN 0.5 ELSE 0 END), 2) AS weight FROM a GROUP BY ALL
"""


def burst_events(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "events").select(
        F.col("user_id").alias("entity_id"), F.col("event_type").alias("signal"), (F.col("value") / 100).alias("value"), F.lit(0.5).alias("confidence"),
        F.col("ts").cast("timestamp").alias("created_at"))
    return alerts.bursts(claims, ["error", "click"], EVENTS_AS_OF).select("entity_id", "signal", "n_claims", F.round("severity", 3).alias("severity"), "first_seen", "expires_at")


BURST_EVENTS = """
SELECT user_id AS entity_id, event_type AS signal, count(*) AS n_claims, round(greatest(CAST(0.7 AS DOUBLE), CAST(0.5 AS DOUBLE)), 3) AS severity,
       min(ts) AS first_seen, TIMESTAMP '2024-02-16' AS expires_at
FROM events WHERE event_type IN ('error', 'click') AND value / 100 > CAST(0.6 AS DOUBLE) AND ts >= TIMESTAMP '2024-01-25' AND ts <= TIMESTAMP '2024-02-01'
GROUP BY ALL HAVING count(*) >= 3
"""


def ttl_active(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 15 DAYS")).alias("expires_at"))
    return rows.where(F.col("expires_at") > state.at_time(EVENTS_AS_OF))


TTL_ACTIVE = "SELECT event_id, ts + INTERVAL 15 DAY AS expires_at FROM events WHERE ts + INTERVAL 15 DAY > TIMESTAMP '2024-02-01'"


def field_overrides(spark: SparkSession, d: str) -> DataFrame:
    obs = event_observations(spark, d).withColumn("value_bool", F.col("value_num") > 90)
    states = state.aggregate_observations(obs, event_signals(spark, d, "boolean", 30), EVENTS_AS_OF).withColumn("half_life", F.lit(30))
    return reconcile.temporal_overrides(states, {"click": ("water",), "view": ("power",), "error": ("grey_dump", "black_dump")}, EVENTS_AS_OF).select(
        "entity_id", "field", "source_signal", F.col("expires_on").cast("string").alias("expires_on"))


FIELD_OVERRIDES = f"""
WITH {OBSERVATIONS_SQL}, s AS (
  SELECT entity_id, signal, count(*) AS n, coalesce(sum(w) FILTER (WHERE value > 90), 0) AS t, coalesce(sum(w) FILTER (WHERE NOT value > 90), 0) AS f
  FROM obs GROUP BY entity_id, signal HAVING sum(w) > 0
), m(signal, field) AS (VALUES ('click', 'water'), ('view', 'power'), ('error', 'grey_dump'), ('error', 'black_dump'))
SELECT entity_id, field, s.signal AS source_signal, '2024-03-02' AS expires_on FROM s JOIN m USING (signal)
WHERE t < f AND n >= 2 AND round(t + f, 6) >= CAST(1.5 AS DOUBLE) AND round((f - t) / (t + f) * least(1, (t + f) / 3), 6) >= CAST(0.7 AS DOUBLE)
"""

QUERIES = {
    "decay_state": (decay_state, DECAY_STATE), "boolean_consensus": (boolean_consensus, BOOLEAN_CONSENSUS), "text_mode": (text_mode, TEXT_MODE),
    "regime_change": (regime_change, REGIME_CHANGE), "signal_distance": (signal_distance, SIGNAL_DISTANCE), "closure_reopen": (closure_reopen, CLOSURE_REOPEN),
    "needs_recompute": (needs_recompute, NEEDS_RECOMPUTE), "stale_keys": (stale_keys, STALE_KEYS), "latest_run": (latest_run, LATEST_RUN),
    "dedup_latest": (dedup_latest, DEDUP_LATEST), "health_light": (health_light, HEALTH_LIGHT), "alert_decay": (alert_decay, ALERT_DECAY),
    "alert_lifecycle": (alert_lifecycle, ALERT_LIFECYCLE), "burst_events": (burst_events, BURST_EVENTS), "ttl_active": (ttl_active, TTL_ACTIVE),
    "field_overrides": (field_overrides, FIELD_OVERRIDES),
}
