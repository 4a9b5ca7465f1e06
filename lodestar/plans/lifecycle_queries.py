"""Queries on merges, snapshots, sources, vehicle limits and what reviews lead to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import claims, ingestion, merging, metrics, reconcile, reviews, search, vehicles
from lodestar.plans.inputs import EVENTS_AS_OF, customers, place_sql
from lodestar.plans.text_queries import CLEAN_SQL, RULES
from lodestar.sources import connectors
from lodestar.sources.streams import stream_table
from lodestar.sources.tables import table
from lodestar.streaming import incremental

_SOURCES = ("park4night", "caramaps", "campy", "promobil", "campingcarpark", "other")
_RAW = """concat('{"hauteur_limite": "', p_size / 10, '", "maxHeight": ', p_size, ', "maxLength": "', p_size % 17, '.5", "maxWidth": "1e1", "camperSize": "', p_size, ' m", "caravan8Meters": ',
 CASE WHEN p_partkey % 2 = 0 THEN 'false' ELSE 'true' END, ', "prohibitions": {"vehicleMore9m": ', CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'null' END, '}}')"""


def vehicle_limits(spark: SparkSession, d: str) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("p_partkey") % len(_SOURCES) + 1).cast("int"))
    records = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("spot_id"), source.alias("source"), F.expr(_RAW.replace("p_size / 10", "CAST(CAST(p_size AS DOUBLE) / 10 AS STRING)")).alias("raw"))
    return vehicles.tightest_limits(vehicles.source_limits(records), "spot_id", ["height_m", "length_m", "width_m"])


VEHICLE_LIMITS = f"""
WITH r AS (SELECT p_partkey % 40 AS spot_id, [{', '.join(f"'{s}'" for s in _SOURCES)}][CAST(p_partkey % {len(_SOURCES)} AS INTEGER) + 1] AS source, p_partkey, CAST(p_size AS DOUBLE) AS n FROM part),
l AS (SELECT spot_id, 'h' AS k, n / 10 AS v, source FROM r WHERE source = 'park4night' AND n / 10 BETWEEN 1.5 AND 4.5 UNION ALL SELECT spot_id, 'h', n, source FROM r WHERE source = 'caramaps' AND n BETWEEN 1.5 AND 4.5
  UNION ALL SELECT spot_id, 'l', n % 17 + 0.5, source FROM r WHERE source = 'caramaps' AND n % 17 + 0.5 BETWEEN 3 AND 15 UNION ALL SELECT spot_id, 'l', 8, source FROM r WHERE source = 'promobil' AND p_partkey % 2 = 0
  UNION ALL SELECT spot_id, 'l', 9, source FROM r WHERE source = 'campingcarpark' AND p_partkey % 3 = 0),
c(source, sure) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in vehicles.SOURCE_CONFIDENCE.items())}),
b AS (SELECT *, row_number() OVER (PARTITION BY spot_id, k ORDER BY v, source) AS rn FROM l JOIN c USING (source)), f AS (SELECT * FROM b WHERE rn = 1)
SELECT spot_id, max(v) FILTER (WHERE k = 'h') AS height_m, max(source) FILTER (WHERE k = 'h') AS height_m_source, CAST(max(sure) FILTER (WHERE k = 'h') AS DOUBLE) AS height_m_confidence,
  max(v) FILTER (WHERE k = 'l') AS length_m, max(source) FILTER (WHERE k = 'l') AS length_m_source, CAST(max(sure) FILTER (WHERE k = 'l') AS DOUBLE) AS length_m_confidence,
  CAST(NULL AS DOUBLE) AS width_m, CAST(NULL AS VARCHAR) AS width_m_source, CAST(NULL AS DOUBLE) AS width_m_confidence FROM f GROUP BY spot_id
"""


def escalation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("n", F.col("doc_id") % 5)
    seen = claims.mentions_ambiguous(F.col("text"), RULES)
    return rows.groupBy("lang").agg(*[F.count_if(claims.should_escalate(m, F.col("text"), F.col("n"), seen)).alias(m) for m in ("hybrid", "llm_only", "regex_only")])


_DENIED = "', '".join(claims.NEGATIONS)
ESCALATION = rf"""
WITH c AS (SELECT doc_id, list_filter(string_split_regex(unnest(string_split_regex(lower(text), '[.!?;:\n,]')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM c), s AS (SELECT DISTINCT doc_id FROM i WHERE w[p] = 'that' AND NOT list_has_any(w[greatest(1, p - 3):p - 1], ['{_DENIED}']))
SELECT lang, count(*) FILTER (WHERE s.doc_id IS NOT NULL OR (length(text) >= 120 AND d.doc_id % 5 < 3)) AS hybrid, count(*) FILTER (WHERE length(text) >= 30) AS llm_only, 0 AS regex_only
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY lang
"""


def richness(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderpriority").alias("langs"), F.count_distinct("o_orderstatus").alias("sources"))
    score = metrics.richness(F.col("n"), F.col("o_custkey") % 20, F.col("langs"), F.col("sources"))
    return per.select("o_custkey", score.alias("richness"), metrics.richness_level(score).alias("level"))


RICHNESS = """
WITH p AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS l, count(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1),
r AS (SELECT o_custkey, round(CAST(0.5 AS DOUBLE) * least(n / CAST(20 AS DOUBLE), 1) + CAST(0.3 AS DOUBLE) * least(o_custkey % 20 / CAST(15 AS DOUBLE), 1) + CAST(0.1 AS DOUBLE) * least(l / CAST(4 AS DOUBLE), 1) + CAST(0.1 AS DOUBLE) * least(s / CAST(3 AS DOUBLE), 1), 3) AS richness FROM p)
SELECT o_custkey, richness, CASE WHEN richness >= 0.8 THEN 4 WHEN richness >= 0.55 THEN 3 WHEN richness >= 0.3 THEN 2 WHEN richness >= 0.1 THEN 1 ELSE 0 END AS level FROM r
"""


def insert_new(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("s"), F.col("o_orderkey").alias("id"))
    return reconcile.insert_new(o.where("id < 100"), o.where("id >= 100"), ["k", "s"], [F.col("id")])


INSERT_NEW = """
WITH o AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS s, o_orderkey AS id FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY id) AS rn FROM o WHERE id >= 100)
SELECT k, s, id FROM o WHERE id < 100 UNION ALL SELECT k, s, id FROM n WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.id < 100 AND o.k IS NOT DISTINCT FROM n.k AND o.s IS NOT DISTINCT FROM n.s)
"""

_TOLD = "concat(substr(text, 1, 50), CASE doc_id % 6 WHEN 0 THEN ' see https://www.campsite.example/a?b=1). more' WHEN 1 THEN ' www.lake.example, now' WHEN 2 THEN ' http://facebook.com/x' WHEN 3 THEN ' http://a.example} http://b.example' ELSE '' END)"


def website_recovery(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{_TOLD} AS told")
    return rows.select("doc_id", text.official_website(F.lit(None).cast("string"), F.col("told")).alias("website"))


WEBSITE_RECOVERY = """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'https://www.campsite.example/a?b=1' WHEN 1 THEN 'http://www.lake.example' WHEN 3 THEN 'http://a.example' END AS website FROM documents
"""

_PLACE = """concat('{"id": "', c_custkey, '", "name": "', c_name, '", "place_id": ', c_custkey, ', "place_type_id": ', c_custkey % 14, ', "latitude": "', lat, '", "longitude": ', lon, ', "b_water": ', c_custkey % 2, ', "price": "', c_custkey % 3, '", "capacity": "x", "rm": 4}')"""


def source_records(spark: SparkSession, d: str) -> DataFrame:
    """Raw JSON of one source as canonical records, with the checksum of the payload and its merge with an older one."""
    raw = customers(spark, d).withColumn("lat", F.when(F.col("c_custkey") % 10 > 0, F.col("lat"))).selectExpr(f"{_PLACE.replace('lat,', 'coalesce(CAST(lat AS STRING), \'\'),')} AS raw")
    out = connectors.normalize(raw, "womostell")
    return out.select("source_id", "nombre", F.round("lat", 4).alias("lat"), "tipo", "agua_potable", "gratuito", "num_plazas", "rating")


SOURCE_RECORDS = f"""
SELECT CAST(c_custkey AS VARCHAR) AS source_id, c_name AS nombre, round(lat, 4) AS lat, CASE c_custkey % 14 WHEN 1 THEN 'parking' WHEN 4 THEN 'camping' WHEN 5 THEN 'naturaleza' WHEN 6 THEN 'parking' WHEN 7 THEN 'parking' WHEN 10 THEN 'parking' WHEN 12 THEN 'wild' ELSE 'area_ac' END AS tipo,
  c_custkey % 2 = 1 AS agua_potable, c_custkey % 3 = 0 AS gratuito, CAST(NULL AS INTEGER) AS num_plazas, CAST(4 AS DOUBLE) AS rating FROM (SELECT *, {place_sql('c_custkey')} FROM customer) WHERE c_custkey % 10 > 0
"""


def payload_merge(spark: SparkSession, d: str) -> DataFrame:
    """A payload merged into the one before it, the newer members winning, and whether it changed at all."""
    rows = table(spark, d, "events").selectExpr("event_id", "props AS old", "concat('{\"n\": \"', event_type, '\"', CASE WHEN event_id % 2 = 0 THEN ', \"k\": 5}' ELSE '}' END) AS new")
    rows = rows.withColumn("m", connectors.merge_json(F.col("old"), F.col("new")))
    same = connectors.checksum(F.col("m")) == connectors.checksum(F.col("old"))
    return rows.select("event_id", F.get_json_object("m", "$.k").alias("k"), F.get_json_object("m", "$.n").alias("n"), same.alias("unchanged"))


PAYLOAD_MERGE = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '5' ELSE json_extract_string(props, '$.k') END AS k, event_type AS n, false AS unchanged FROM events"


def faceted_search(spark: SparkSession, d: str) -> DataFrame:
    """All facets at once: places joined to their state only by an inner join where a facet asks for the state."""
    spots = customers(spark, d).selectExpr("c_custkey AS spot_id", "c_name AS name", "lower(c_mktsegment) AS type", "c_custkey % 2 = 0 AS free", "c_custkey % 3 > 0 AS water", "array(c_mktsegment, 'base') AS sources", "c_acctbal AS rating")
    state = table(spark, d, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) / 20.0).alias("quietness"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0)).alias("risk")).withColumnRenamed("o_custkey", "spot_id")
    wanted = {"free": True, "water": True, "source": "base", "name": "00"}
    plain = search.faceted_places(spots, state, **wanted).select("spot_id", F.lit("plain").alias("kind"))
    return plain.union(search.faceted_places(spots, state, **wanted, min_quietness=0.4, max_risk=0.9).select("spot_id", F.lit("state").alias("kind")))


FACETED_SEARCH = """
WITH s AS (SELECT o_custkey, count(*) / CAST(20 AS DOUBLE) AS q, avg(CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) END) AS r FROM orders GROUP BY 1),
p AS (SELECT c_custkey AS spot_id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 > 0 AND c_name ILIKE '%00%')
SELECT spot_id, 'plain' AS kind FROM p UNION ALL SELECT spot_id, 'state' FROM p JOIN s ON spot_id = o_custkey WHERE q >= 0.4 AND coalesce(r, 0) <= 0.9
"""


def left_on_predicate(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    joined = c.join(o, (F.col("c_custkey") == F.col("o_custkey")) & F.col("o_orderpriority").like("1%"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_urgent"))


LEFT_ON_PREDICATE = "SELECT c_custkey, count(o_orderkey) AS n_urgent FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority LIKE '1%' GROUP BY 1"


def html_records(spark: SparkSession, d: str) -> DataFrame:
    """Titles, languages and headings of raw pages, as records."""
    at = lambda pattern: F.regexp_extract("html", pattern, 1)
    return table(spark, d, "pages").select("page_id", at(r"<title>([^<]*)</title>").alias("title"), at(r'<html lang="([a-z]+)"').alias("lang"), F.regexp_count("html", F.lit("<h[1-6]")).cast("long").alias("n_headings"))


HTML_RECORDS = r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<h[1-6]')) AS BIGINT) AS n_headings FROM pages
"""


def merge_shells(spark: SparkSession, d: str) -> DataFrame:
    """Spots after merges of every tenth into the one below it: reviews moved once, sources united, shells inactive."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    spots = c.select(F.col("c_custkey").alias("spot_id"), F.array("c_mktsegment").alias("sources"), F.lit(True).alias("active"), F.lit(None).cast("string").alias("warning"))
    reviews_ = o.select(F.col("o_custkey").alias("spot_id"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("source_review_id"), F.col("o_orderkey").alias("review_id"))
    mapping = c.where("c_custkey % 10 = 9").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") - 1).alias("new_id"))
    merged = merging.merge_shells(spots, reviews_, mapping)
    return merged.select("spot_id", F.array_join("sources", ",").alias("sources"), "active", "warning", "total_reviews")


MERGE_SHELLS = """
WITH r AS (SELECT DISTINCT CASE WHEN o_custkey % 10 = 9 THEN o_custkey - 1 ELSE o_custkey END AS s, o_orderstatus, o_orderpriority FROM orders), n AS (SELECT s, count(*) AS n FROM r GROUP BY 1)
SELECT c.c_custkey AS spot_id, CASE WHEN x.c_custkey IS NULL OR x.c_mktsegment = c.c_mktsegment THEN c.c_mktsegment ELSE least(c.c_mktsegment, x.c_mktsegment) || ',' || greatest(c.c_mktsegment, x.c_mktsegment) END AS sources,
  c.c_custkey % 10 <> 9 AS active, CASE WHEN c.c_custkey % 10 = 9 THEN 'merged into ' || (c.c_custkey - 1) END AS warning, coalesce(n, 0) AS total_reviews
FROM customer c LEFT JOIN customer x ON x.c_custkey = c.c_custkey + 1 AND x.c_custkey % 10 = 9 LEFT JOIN n ON s = c.c_custkey
"""


def shift_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of shifts: one for each entity and day, with the greatest distance of that day and the last state."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("day"), (F.col("value") / 100).alias("distance"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return merging.shift_snapshots(rows).select("entity_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "distance", "state")


SHIFT_SNAPSHOTS = """
SELECT user_id AS entity_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, max(value / 100) AS distance, arg_max(event_type, event_id) AS state FROM events WHERE value / 100 > CAST(0.15 AS DOUBLE) GROUP BY user_id, CAST(ts AS DATE)
"""


def near_dup_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as reviews of one place each, without near copies; greedy, so without SQL."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") % 5).alias("spot_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("review_id"), "text", F.lit("2024-01-01").cast("timestamp").alias("at"))
    return reviews.drop_near_duplicates(rows).select("spot_id", "review_id")


def review_selection(spark: SparkSession, d: str) -> DataFrame:
    """Documents as reviews of their source: what fits a budget, spread over the months."""
    at = F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 37 % 900).cast("int"))
    rows = table(spark, d, "documents").select(F.col("source").alias("spot_id"), F.col("doc_id").alias("review_id"), "text", F.when(F.col("doc_id") % 11 > 0, at).alias("at"), (F.col("doc_id") % 50 / 10.0).alias("rating"))
    out = reviews.selected(rows, F.lit("2024-01-01").cast("date"), 600)
    return out.select("spot_id", "review_id", "place", "weight", F.md5("text").alias("text_md5"))


REVIEW_SELECTION = rf"""
WITH t AS (SELECT source AS spot_id, doc_id AS review_id, CASE WHEN doc_id % 11 > 0 THEN DATE '2024-01-01' - CAST(doc_id * 37 % 900 AS INTEGER) END AS seen, CAST(doc_id % 50 AS DOUBLE) / 10 AS rating, {CLEAN_SQL.replace('{c}', 'text')} AS c FROM documents),
f AS (SELECT *, len(regexp_extract_all(c, '[A-Za-zÀ-ÿ]{{3,}}')) AS n FROM t WHERE length(c) >= 10),
w AS (SELECT *, CASE WHEN seen IS NULL THEN CAST(0.3 AS DOUBLE) WHEN date_diff('day', seen, DATE '2024-01-01') < 365 THEN 1 WHEN date_diff('day', seen, DATE '2024-01-01') < 730 THEN 0.8 ELSE 0.5 END AS weight,
  coalesce(year(seen) * 12 + month(seen) - 1, -1) AS m, CASE WHEN length(c) <= 400 THEN c ELSE rtrim(substr(c, 1, 399)) || '…' END AS s FROM f WHERE n >= 3 AND NOT (n <= 3 AND len(list_filter(string_split_regex(lower(c), '[^\p{{L}}\p{{N}}_]+'), lambda x: x IN ({", ".join(repr(x) for x in text.FILLER_WORDS)}))) > 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY spot_id, m ORDER BY weight DESC, floor(rating * 10) DESC, length(c) DESC, review_id) AS rnd, greatest(1, length(s) // 4) + 20 AS tok FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY rnd, m DESC) AS place, sum(tok) OVER (PARTITION BY spot_id ORDER BY rnd, m DESC ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT spot_id, review_id, place, weight, md5(CASE WHEN place = 1 AND upto > 600 THEN CASE WHEN length(c) <= 200 THEN c ELSE rtrim(substr(c, 1, 199)) || '…' END ELSE s END) AS text_md5 FROM o WHERE upto <= 600 OR place = 1
"""


def name_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of names by matching blocks, and the nearest known tag; difflib's, so without SQL."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return rows.select("p_partkey", F.round(reviews.sequence_ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"), reviews.close_matches(F.lower("p_type"), ["economic", "smaller", "large"]).alias("tag"))


def burst_stream(spark: SparkSession, d: str) -> DataFrame:
    """Counts of strong claims in sliding windows over the events as a stream."""
    from lodestar.plans.text_queries import stream_folder

    events = stream_table(spark, d, "events").where("value > 60").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("signal"), F.col("ts").cast("timestamp").alias("created_at"))
    counted = incremental.burst_counts(events).select("entity_id", "signal", F.unix_seconds("window.start").alias("start"), "n_claims")
    return incremental.run_once(counted, ["entity_id", "signal", "start"], stream_folder(spark, f"burst_stream_{uuid.uuid4().hex}"))


BURST_STREAM = """
WITH e AS (SELECT user_id AS entity_id, event_type AS signal, CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 86400) AS BIGINT) AS day FROM events WHERE value > 60)
SELECT entity_id, signal, (day - k) * 86400 AS start, count(*) AS n_claims FROM e, range(7) x(k) GROUP BY ALL
"""

_CLAIMED = """SELECT conv_id AS spot_id, CASE turn % 3 WHEN 0 THEN 'quietness' WHEN 1 THEN 'dog_friendly' ELSE 'unheard' END AS signal, CASE turn % 3 WHEN 0 THEN '0,4' ELSE 'TRUE' END AS value,
  CAST(0.8 AS DOUBLE) AS confidence, CASE WHEN turn % 5 = 0 THEN NULL WHEN turn % 7 = 0 THEN -1 ELSE conv_id * 1000 + turn END AS review_id,
  CASE WHEN turn % 4 = 1 THEN 'entirely different statement' WHEN turn % 4 = 2 THEN '' ELSE substr(text, 1, 60) END AS excerpt, conv_id * 1000 + turn AS seq FROM {t}"""
_REVIEWED = "SELECT conv_id * 1000 + turn AS review_id, text, CAST(TIMESTAMP '2024-01-01 00:00:00' AS TIMESTAMP) AS at, CAST(0.5 AS DOUBLE) AS source_confidence FROM {t}"


def llm_ingestion(spark: SparkSession, d: str) -> DataFrame:
    """Observations of the claims that are known, founded and new, and how many claims are stored then."""
    t = table(spark, d, "conversations")
    rows, texts = (spark.sql(q, t=t) for q in (_CLAIMED, _REVIEWED))
    stored = rows.where("seq % 10 = 0").select("spot_id", "signal", "review_id", "value", "confidence").distinct()
    signals = spark.createDataFrame([("quietness", "numeric"), ("dog_friendly", "boolean")], "signal string, value_type string")
    _, seen = ingestion.ingested(rows, texts, stored, signals, EVENTS_AS_OF)
    return seen.select("claim_id", "signal", "value_num", "value_bool", F.round("weight", 9).alias("weight"), "date_estimated")


LLM_INGESTION = rf"""
WITH c AS ({_CLAIMED.format(t='conversations')}), r AS ({_REVIEWED.format(t='conversations').replace(' AS at,', ' AS seen,')}),
w AS (SELECT c.*, r.text AS cited, seen, source_confidence, list_filter(string_split_regex(lower(excerpt), '[^\p{{L}}\p{{Nd}}]+'), lambda x: length(x) >= 4) AS k FROM c LEFT JOIN r ON c.review_id = r.review_id WHERE signal <> 'unheard'),
g AS (SELECT * FROM w WHERE trim(coalesce(excerpt, '')) = '' OR review_id IS NULL OR (cited IS NOT NULL AND (len(k) = 0 OR CAST(len(list_filter(k, lambda x: list_contains(list_filter(string_split_regex(lower(cited), '[^\p{{L}}\p{{Nd}}]+'), lambda y: length(y) >= 4), x))) AS DOUBLE) / len(k) >= CAST(0.34 AS DOUBLE)))),
n AS (SELECT *, row_number() OVER (PARTITION BY spot_id, signal, review_id ORDER BY seq) AS rn FROM g)
SELECT seq AS claim_id, signal, CASE WHEN signal = 'quietness' THEN CAST(0.4 AS DOUBLE) END AS value_num, CASE WHEN signal = 'dog_friendly' THEN true END AS value_bool,
  round(CAST(0.8 AS DOUBLE) * coalesce(source_confidence, 1) * CASE WHEN seen IS NULL THEN CAST(0.6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 9) AS weight, seen IS NULL AS date_estimated
FROM n WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.seq % 10 = 0 AND c.spot_id = n.spot_id AND c.signal = n.signal AND c.review_id IS NOT DISTINCT FROM n.review_id)
"""


def promoted_tags(spark: SparkSession, d: str) -> DataFrame:
    """Aliases after the promotion of some unknown tags, and which of the unknown ones are reviewed."""
    p = table(spark, d, "part")
    aliases = p.where("p_partkey < 5").select(text.kebab(F.col("p_name")).alias("alias"), text.kebab(F.col("p_type")).alias("tag")).groupBy("alias").agg(F.min("tag").alias("tag"))
    unknown = p.groupBy(text.kebab(F.col("p_name")).alias("alias")).agg(F.count(F.lit(1)).alias("n")).withColumn("reviewed", F.lit(False))
    decisions = p.where("p_partkey BETWEEN 3 AND 9").select(F.upper("p_name").alias("raw"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("target"))
    known, marked = ingestion.promoted(aliases, unknown, decisions)
    return known.select("alias", "tag").union(marked.where("reviewed").select("alias", F.lit("reviewed")))


PROMOTED_TAGS = r"""
WITH p AS (SELECT p_partkey, replace(lower(p_name), ' ', '-') AS a, replace(lower(p_type), ' ', '-') AS t, regexp_replace(lower(p_brand), '[^a-z0-9-]', '', 'g') AS b FROM part),
al AS (SELECT a, min(t) AS t FROM p WHERE p_partkey < 5 GROUP BY 1), c AS (SELECT a, CASE WHEN p_partkey % 2 = 0 THEN b ELSE a END AS t FROM p WHERE p_partkey BETWEEN 3 AND 9),
w AS (SELECT a, min(t) AS t FROM (SELECT a, t FROM c UNION ALL SELECT t, t FROM c) GROUP BY 1)
SELECT a AS alias, t AS tag FROM al UNION ALL SELECT a, t FROM w WHERE a NOT IN (SELECT a FROM al) UNION ALL SELECT DISTINCT a, 'reviewed' FROM p WHERE a IN (SELECT a FROM w)
"""

LATE = {"near_dup_reviews": (near_dup_reviews, ""), "name_ratio": (name_ratio, "")}
QUERIES = {k.lower(): (globals()[k.lower()], v) for k, v in list(globals().items()) if k.isupper() and k[0] != "_" and isinstance(v, str) and callable(globals().get(k.lower()))} | LATE
