"""Queries on claims, facts, observations and the words made of states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import objects, text, wording
from lodestar.operators import facts, observations
from lodestar.plans.inputs import EVENTS_AS_OF, event_observations
from lodestar.sources.tables import table

#: Values, confidences and types that events stand for, in words that both engines read.
RAW = "CASE event_id % 8 WHEN 0 THEN 'yes' WHEN 1 THEN ' No ' WHEN 2 THEN '0,75' WHEN 3 THEN 'high' WHEN 4 THEN '1.7' WHEN 5 THEN 'maybe' WHEN 6 THEN '' ELSE '-1e-3' END"
AT = "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL '60' DAY ELSE CAST(ts AS TIMESTAMP) END"
SURE = "CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END"
KIND = "CASE WHEN event_type IN ('view', 'click') THEN 'boolean' WHEN event_type IN ('purchase', 'error') THEN 'numeric' ELSE 'text' END"


def _words(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def normalize_observations(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    claims = events.selectExpr(
        "event_id AS claim_id", "user_id AS entity_id", "event_type AS signal", f"{RAW} AS raw", "CAST(event_id % 10 AS DOUBLE) / 10 AS confidence",
        f"{SURE} AS source_confidence", "CAST(1.2 AS DOUBLE) AS reviewer_confidence", f"{AT} AS at", "event_id % 17 = 0 AS estimated")
    signals = spark.createDataFrame([("view", "boolean"), ("click", "boolean"), ("purchase", "numeric"), ("error", "numeric"), ("signup", "text")], "signal string, value_type string")
    out = observations.normalize(claims, signals, EVENTS_AS_OF)
    return out.select("claim_id", "signal", "value_num", "value_bool", "value_text", F.round("weight", 9).alias("weight"),
                      F.unix_seconds("observed_at").alias("observed_epoch"), "date_estimated")


NORMALIZE_OBSERVATIONS = f"""
WITH c AS (
  SELECT event_id AS claim_id, event_type AS signal, {RAW} AS raw, CAST(event_id % 10 AS DOUBLE) / 10 AS conf, {SURE} AS src, {AT} AS seen_at, event_id % 17 = 0 AS est, {KIND} AS kind FROM events
), n AS (
  SELECT *, lower(trim(raw)) AS w, try_cast(nullif(replace(trim(raw), ',', '.'), '') AS DOUBLE) AS num,
         seen_at IS NULL OR seen_at > TIMESTAMP '2024-02-03' AS unknown FROM c
), v AS (
  SELECT *, CASE WHEN kind = 'numeric' THEN coalesce(num, CASE {' '.join(f"WHEN w = '{k}' THEN CAST({v} AS DOUBLE)" for k, v in observations.LEVEL_WORDS.items())} END) END AS x,
         CASE WHEN kind = 'boolean' THEN CASE WHEN w IN ({_words(observations.TRUE_WORDS)}) THEN true WHEN w IN ({_words(observations.FALSE_WORDS)}) THEN false END END AS value_bool,
         CASE WHEN kind = 'text' THEN nullif(trim(raw), '') END AS value_text, est OR unknown AS date_estimated FROM n
)
SELECT claim_id, signal, CASE WHEN x IS NOT NULL THEN least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), x)) END AS value_num, value_bool, value_text,
       round(conf * CASE WHEN coalesce(src, 0) = 0 THEN CAST(1 AS DOUBLE) ELSE src END * CASE WHEN date_estimated THEN CAST(0.6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 9) AS weight,
       CAST(epoch(date_trunc('second', CASE WHEN unknown THEN TIMESTAMP '2024-02-01' ELSE seen_at END)) AS BIGINT) AS observed_epoch, date_estimated
FROM v WHERE x IS NOT NULL OR value_bool IS NOT NULL OR value_text IS NOT NULL
"""

#: Facts that parts stand for.
FACTS = """concat('{"agua_potable": ', CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '"no"' ELSE 'null' END, ', "vaciado_grises": ', CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE 'false' END,
 ', "wifi": "', p_type, '", "altura_max_m": "', p_size, '.24", "num_plazas": ', p_size, ', "servicios_extras": {"bbq": ', CASE WHEN p_partkey % 5 = 0 THEN 'true' ELSE '"x"' END,
 ', "campfire": ', CASE WHEN p_partkey % 4 = 0 THEN 'false' ELSE 'true' END, ', "ground": "', CASE WHEN p_partkey % 2 = 0 THEN 'Gravel' ELSE 'mud' END,
 '", "environment_labels": ["', CASE p_partkey % 4 WHEN 0 THEN 'beach' WHEN 1 THEN 'forest' WHEN 2 THEN 'moon' ELSE 'Sea' END, '", "secluded"], "vibes": ["romantic"], "prohibitions": ["',
 CASE WHEN p_partkey % 7 = 0 THEN 'no Campfire or dogs' ELSE 'noise at night' END, '"], "max_vehicle_length_ft": ', p_size, ', "activities": ["', CASE WHEN p_partkey % 2 = 0 THEN 'SUP' ELSE 'mtb' END, '", "skiing"]}}')"""


def facts_to_claims(spark: SparkSession, d: str) -> DataFrame:
    return facts.claims_of_facts(table(spark, d, "part").selectExpr("p_partkey AS record_id", f"{FACTS} AS facts"))


def _rows(rows) -> str:
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, (i, *r))) + ")" for i, r in enumerate(rows))


def _flag_sql(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) IN ({_words(facts.TRUE)}) THEN true WHEN lower(trim({x})) IN ({_words(facts.FALSE)}) THEN false END"


FACTS_TO_CLAIMS = f"""
WITH f AS (SELECT p_partkey AS record_id, {FACTS} AS j FROM part),
fields(i, field, signal, yes, no, conf) AS ({_rows(facts.FIELDS)}), extras(i, k, want, signal, value, conf) AS ({_rows(facts.EXTRAS)}), texts(i, k, t, signal, value, conf) AS ({_rows(facts.TEXTS)}),
items(i, k, t, signal, value, conf) AS ({_rows(facts.ITEMS)}), bans(i, t, signal, value, conf) AS ({_rows(facts.PROHIBITIONS)}),
sports(i, t, signal, value, conf) AS ({_rows([(n, *rest) for names, *rest in facts.ACTIVITIES for n in names])}),
lists AS (SELECT record_id, k, unnest(CAST(json_extract(j, '$.servicios_extras.' || k) AS VARCHAR[])) AS item, generate_subscripts(CAST(json_extract(j, '$.servicios_extras.' || k) AS VARCHAR[]), 1) AS pos
  FROM f, (VALUES ('environment_labels'), ('vibes'), ('prohibitions'), ('activities')) x(k)),
n AS (SELECT record_id, CAST(json_extract_string(j, '$.altura_max_m') AS DOUBLE) AS height, CAST(json_extract_string(j, '$.num_plazas') AS INTEGER) AS places,
  CAST(json_extract_string(j, '$.servicios_extras.max_vehicle_length_ft') AS DOUBLE) AS feet FROM f),
c AS (
  SELECT record_id, i AS ord, signal, CASE WHEN b THEN yes WHEN NOT b THEN no END AS value, conf FROM (SELECT *, {_flag_sql("json_extract_string(j, '$.' || field)")} AS b FROM f, fields)
  UNION ALL SELECT record_id, 100, 'height_restriction', CAST(round(height, 1) AS VARCHAR), 0.95 FROM n WHERE height > 0
  UNION ALL SELECT record_id, 101, 'parking_capacity', CASE WHEN places BETWEEN 1 AND 5 THEN 'small' WHEN places >= 30 THEN 'big' END, 0.85 FROM n
  UNION ALL SELECT record_id, 200 + i, signal, value, conf FROM (SELECT *, {_flag_sql("json_extract_string(j, '$.servicios_extras.' || k)")} AS b FROM f, extras) WHERE b = want
  UNION ALL SELECT record_id, 300 + i, signal, value, conf FROM f, texts WHERE lower(trim(json_extract_string(j, '$.servicios_extras.' || k))) = t
  UNION ALL SELECT record_id, CASE k WHEN 'vibes' THEN 2000 ELSE 1000 END + pos, signal, value, conf FROM lists JOIN items USING (k) WHERE lower(item) = t
  UNION ALL SELECT record_id, 3000 + pos * 10 + i, signal, value, conf FROM lists, bans WHERE k = 'prohibitions' AND contains(lower(item), t)
  UNION ALL SELECT record_id, 4000, 'large_vehicle', CASE WHEN feet >= 23 THEN '0.85' WHEN feet > 0 THEN '0.15' END, CASE WHEN feet >= 23 THEN 0.85 ELSE 0.88 END FROM n
  UNION ALL SELECT record_id, 5000 + i, signal, value, conf FROM lists, sports WHERE k = 'activities' AND lower(item) = t
)
SELECT record_id, signal, value, CAST(conf AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY record_id, signal ORDER BY ord) AS rn FROM c WHERE value IS NOT NULL) WHERE rn = 1
"""


def noise_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = event_observations(spark, d).withColumn("signal", F.lit("noise_source")).withColumn("value_text", F.concat(F.lit(" "), F.upper("value_text")))
    return observations.noise_sources(rows, EVENTS_AS_OF).select("entity_id", F.array_join("noise_sources", ",").alias("noise_sources"))


_OBS = """WITH o AS (SELECT user_id AS entity_id, event_type AS name, event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS DOUBLE) / 100 AS weight,
  greatest(CAST(0 AS DOUBLE), CAST(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 86400e6) AS age FROM events)"""
NOISE_SOURCES = _OBS + """, s AS (SELECT entity_id, name, sum(weight * pow(CAST(0.5 AS DOUBLE), age / 365)) AS w FROM o GROUP BY ALL)
SELECT entity_id, string_agg(name, ',' ORDER BY round(w, 9) DESC, name) AS noise_sources FROM s WHERE w >= CAST(0.2 AS DOUBLE) GROUP BY entity_id
"""


def parking_capacity(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("Small", "medium ", "large", "big"))), (F.col("ord") % 4 + 1).cast("int"))
    rows = event_observations(spark, d).withColumn("signal", F.lit("parking_capacity")).withColumn("value_text", name)
    return observations.parking_capacity(rows, EVENTS_AS_OF)


PARKING_CAPACITY = _OBS + """
SELECT entity_id, arg_max(name, k) AS capacity FROM (
  SELECT entity_id, name, {'a': ts, 'b': weight, 'c': name} AS k FROM (SELECT entity_id, ts, weight, CASE event_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' END AS name FROM o) WHERE name IS NOT NULL
) GROUP BY entity_id
"""


def partial_dates(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM') WHEN 1 THEN date_format(o_orderdate, ' yyyy-MM-dd ') WHEN 2 THEN date_format(o_orderdate, 'yyyy-M-d') WHEN 3 THEN '2024-13' ELSE '' END")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(observations.partial_date(raw), "yyyy-MM-dd").alias("day"))


PARTIAL_DATES = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') || '-01' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders
"""

_SIGNALS = list(wording.DSL_KEYS)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Line items as scores: the order is the entity, one signal for each of its lines."""
    i = (F.col("l_linenumber") * 5 + F.col("l_suppkey")) % len(_SIGNALS)
    rows = table(spark, d, "lineitem").withColumn("i", i.cast("int"))
    best = rows.groupBy("l_orderkey", "i").agg(F.max_by(F.struct("l_partkey", "l_returnflag"), F.struct("l_linenumber", "l_partkey")).alias("x"))
    key, kind = F.col("x.l_partkey"), F.col("i") % 3
    return best.select(
        F.col("l_orderkey").alias("entity_id"), F.element_at(F.array(*map(F.lit, _SIGNALS)), F.col("i") + 1).alias("signal"),
        F.when(kind == 0, (key % 97) / 97.0).alias("score_num"), F.when(kind == 1, key % 2 == 0).alias("score_bool"),
        F.when(kind == 2, F.concat(F.lit("flag "), F.col("x.l_returnflag"), F.lit(" of a long description"))).alias("score_text"))


def compact_description(spark: SparkSession, d: str) -> DataFrame:
    return wording.compact_description(_scores(spark, d))


COMPACT_DESCRIPTION = f"""
WITH keys(i, signal, abbr) AS ({_rows(wording.DSL_KEYS.items())}),
b AS (SELECT l_orderkey AS entity_id, (l_linenumber * 5 + l_suppkey) % {len(_SIGNALS)} AS i, arg_max({{'k': l_partkey, 'f': l_returnflag}}, {{'a': l_linenumber, 'b': l_partkey}}) AS x FROM lineitem GROUP BY ALL),
s AS (SELECT entity_id, i, abbr, x.k AS k, x.f AS f, CASE WHEN signal IN ({_words(wording.HIGHER_IS_WORSE)}) THEN CAST(0.5 AS DOUBLE) - CAST(x.k % 97 AS DOUBLE) / 97 ELSE CAST(x.k % 97 AS DOUBLE) / 97 - CAST(0.5 AS DOUBLE) END AS good FROM b JOIN keys USING (i))
SELECT entity_id, string_agg(abbr || ':' || CASE i % 3 WHEN 0 THEN CASE WHEN good >= 0 THEN '+' ELSE '-' END || printf('%.1f', least(CAST(1 AS DOUBLE), abs(good) * 2))
  WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'T' ELSE 'F' END ELSE substr(replace('flag ' || f || ' of a long description', ' ', '_'), 1, 24) END, ' ' ORDER BY i) AS dsl FROM s GROUP BY entity_id
"""


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    score = lambda k: (F.col("p_partkey") * k % 100) / 100.0
    flag = lambda k: F.when(F.col("p_partkey") % k == 0, True).when(F.col("p_partkey") % k == 1, False)
    none = F.lit(None).cast("string")
    spot = {"name": F.col("p_name"), "type": F.lower("p_type"), "region": F.when(F.col("p_size") > 25, F.col("p_brand")), "country": F.lit("es"), "summary": none,
            "tags": F.array(F.lit("a"), F.lit("b")), "best_for": F.array().cast("array<string>"), "season": none, "services": F.filter(F.array(F.when(F.col("p_size") > 10, "wifi")), lambda x: x.isNotNull()), "dsl": none}
    scores = {"quietness": score(7), "beauty": score(11), "police_risk": score(13), "crowd_level": score(17), "overnight_safe": flag(3), "sea_view": flag(2), "road_quality": score(19)}
    return table(spark, d, "part").select("p_partkey", wording.embedding_text(spot, scores).alias("text"))


def _score_sql(k: int) -> str:
    return f"CAST(p_partkey * {k} % 100 AS DOUBLE) / 100"


EMBEDDING_TEXT = f"""
SELECT p_partkey, concat_ws('. ', p_name || ' - ' || lower(p_type), CASE WHEN p_size > 25 THEN 'en ' || p_brand || ', ES' END, 'Tags: a, b', nullif(concat_ws('. ',
  CASE WHEN {_score_sql(7)} > 0.7 THEN 'lugar muy tranquilo y silencioso' WHEN {_score_sql(7)} < 0.3 THEN 'ruidoso, cerca de carretera o zona urbana' END,
  CASE WHEN {_score_sql(11)} > 0.7 THEN 'entorno bonito con buenas vistas' WHEN {_score_sql(11)} < 0.3 THEN 'entorno poco atractivo' END,
  CASE WHEN {_score_sql(13)} > 0.5 THEN 'riesgo de control policial o multa' WHEN {_score_sql(13)} < 0.2 THEN 'sin problemas con policia' END,
  CASE p_partkey % 3 WHEN 0 THEN 'se puede pernoctar' WHEN 1 THEN 'pernocta prohibida o arriesgada' END,
  CASE WHEN {_score_sql(17)} > 0.7 THEN 'muy masificado' WHEN {_score_sql(17)} < 0.3 THEN 'poco frecuentado, solitario' END,
  CASE WHEN p_partkey % 2 = 0 THEN 'vistas al mar' END, CASE WHEN {_score_sql(19)} < 0.3 THEN 'acceso dificil, pista o camino en mal estado' END), ''),
  CASE WHEN p_size > 10 THEN 'Servicios: wifi' END) AS text FROM part
"""


def state_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    parts = {"spot": F.col("p_partkey").cast("string"), "tags": wording.listed(F.array("p_type", "p_brand")), "summary": F.col("p_name"), "season": F.lit(None).cast("string")}
    return table(spark, d, "part").select("p_partkey", wording.fingerprint(parts).alias("fingerprint"))


STATE_FINGERPRINT = "SELECT p_partkey, substr(sha1('spot:' || p_partkey || '|tags:' || least(p_type, p_brand) || ',' || greatest(p_type, p_brand) || '|summary:' || p_name || '|season:'), 1, 16) AS fingerprint FROM part"


def question_filters(spark: SparkSession, d: str) -> DataFrame:
    found = wording.question_filters(F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.map_entries(found).alias("f"))
    pairs = F.array_sort(F.transform("f", lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return rows.select("conv_id", "turn", F.array_join(pairs, ";").alias("filters"))


def _any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


QUESTION_FILTERS = f"""
WITH t AS (SELECT conv_id, turn, lower(text) AS q FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {_any_sql(ws)} THEN '{k}={v}' END" for k, v, ws in wording.INTENTS)},
  CASE WHEN {_any_sql(wording.CAMPING_WORDS)} THEN 'tipo=camping' WHEN {_any_sql(wording.WILD_WORDS)} THEN 'tipo=naturaleza' END], lambda x: x IS NOT NULL)), ';') AS filters FROM t
"""


def language_hints(spark: SparkSession, d: str) -> DataFrame:
    like = lambda words: wording.looks_like(F.col("text"), words)
    return table(spark, d, "documents").select("doc_id", like(wording.SPANISH_HINTS).alias("spanish"), like(wording.ENGLISH_HINTS).alias("english"))


def _hints_sql(words) -> str:
    return f"coalesce(length(text) >= 20 AND len(list_filter(w, lambda x: x IN ({_words(words)}))) >= 3, false)"


LANGUAGE_HINTS = rf"""
WITH t AS (SELECT doc_id, text, string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+') AS w FROM documents)
SELECT doc_id, {_hints_sql(wording.SPANISH_HINTS)} AS spanish, {_hints_sql(wording.ENGLISH_HINTS)} AS english FROM t
"""

_EXPECTED = ("es", "ca", "pt", "it", "fr")
_DETECTED = "CASE doc_id % 7 WHEN 0 THEN 'it' WHEN 1 THEN 'pt' WHEN 2 THEN 'ro' WHEN 3 THEN 'es' ELSE lang END"


def language_prior(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("detected", F.expr(_DETECTED)).withColumn("short", F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 160).cast("int")))
    expected = F.array(F.element_at(F.array(*map(F.lit, _EXPECTED)), (F.floor(F.col("doc_id") / 7) % 5 + 1).cast("int")))
    return rows.select("doc_id", wording.language_with_prior(F.col("detected"), F.col("short"), expected).alias("language"))


LANGUAGE_PRIOR = f"""
WITH t AS (SELECT doc_id, {_DETECTED} AS a, [{_words(_EXPECTED)}][CAST(doc_id // 7 % 5 AS INTEGER) + 1] AS b, length(substr(text, 1, CAST(doc_id % 160 AS INTEGER))) AS n FROM documents),
c(i, a, b, meant) AS ({_rows([(*k, v) for k, v in wording.CONFUSIONS.items()])})
SELECT doc_id, CASE WHEN t.n < 80 AND t.a <> t.b THEN coalesce(c.meant, t.a) ELSE t.a END AS language FROM t LEFT JOIN c ON t.a = c.a AND t.b = c.b
"""


def name_forms(spark: SparkSession, d: str) -> DataFrame:
    """Names as search uses them: without what aggregators add, folded, cut short, and an excerpt."""
    raw = F.expr("concat(CASE p_partkey % 4 WHEN 0 THEN 'Campspace in ' WHEN 1 THEN 'nomady ' ELSE '' END, p_name, ' Épée Çà Ñu', CASE WHEN p_partkey % 3 = 0 THEN ', Moravskoslezsky kraj' ELSE '' END)")
    rows = table(spark, d, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", wording.bare_name(F.col("raw")).alias("bare"), wording.fold(F.col("raw")).alias("folded"),
                       wording.truncated(F.col("raw"), 20).alias("short"), text.excerpt(F.col("raw"), F.lit("Épée"), 6).alias("excerpt"))


NAME_FORMS = r"""
WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Campspace in ' WHEN 1 THEN 'nomady ' ELSE '' END || p_name || ' Épée Çà Ñu' || CASE WHEN p_partkey % 3 = 0 THEN ', Moravskoslezsky kraj' ELSE '' END AS raw, p_name FROM part)
SELECT p_partkey, p_name || ' Épée Çà Ñu' AS bare, strip_accents(lower(raw)) AS folded,
       CASE WHEN length(raw) <= 20 THEN raw ELSE rtrim(substr(raw, 1, 19)) || '…' END AS short,
       trim(substr(raw, greatest(1, strpos(raw, 'Épée') - 6), strpos(raw, 'Épée') - greatest(1, strpos(raw, 'Épée') - 6) + 10)) AS excerpt FROM t
"""

_TERMS = {"obras": 0.85, "chantier": 0.90, "baustelle": 0.92, "the": 0.5, "and": 0.6}


def lexical_blend(spark: SparkSession, d: str) -> DataFrame:
    score = (F.col("doc_id") % 100) / 100.0
    return table(spark, d, "documents").select("doc_id", F.round(wording.blended(score, wording.term_prior(F.col("text"), _TERMS)), 9).alias("confidence"))


LEXICAL_BLEND = f"""
WITH t AS (SELECT doc_id, CAST(doc_id % 100 AS DOUBLE) / 100 AS s, greatest({', '.join(f"CASE WHEN contains(strip_accents(lower(text)), '{k}') THEN CAST({v} AS DOUBLE) END" for k, v in _TERMS.items())}) AS p FROM documents)
SELECT doc_id, round(CASE WHEN p IS NULL THEN s ELSE least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(0.7 AS DOUBLE) * s + CAST(0.3 AS DOUBLE) * p)) END, 9) AS confidence FROM t
"""

_MODELS = (*wording.PRICES, "unknown")


def token_costs(spark: SparkSession, d: str) -> DataFrame:
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("o_orderkey") % len(_MODELS) + 1).cast("int"))
    rows = table(spark, d, "orders").select(model.alias("model"), (F.col("o_orderkey") % 5000).alias("n"), (F.col("o_custkey") % 3000).alias("c"), (F.col("o_custkey") % 700).alias("o"))
    cost = wording.token_cost(F.col("model"), F.col("n"), F.col("c"), F.col("o"))
    ratio = F.when(F.sum("n") > 0, F.sum("c") / F.sum("n")).otherwise(0.0)
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.sum(cost), 6).alias("dollars"), F.round(ratio, 4).alias("cache_ratio"))


TOKEN_COSTS = f"""
WITH p(i, model, a, b, c) AS ({_rows([(m, *v) for m, v in wording.PRICES.items()])}),
r AS (SELECT [{_words(_MODELS)}][CAST(o_orderkey % {len(_MODELS)} AS INTEGER) + 1] AS model, o_orderkey % 5000 AS n, o_custkey % 3000 AS h, o_custkey % 700 AS o FROM orders)
SELECT r.model, count(*) AS n_calls, round(sum(coalesce((greatest(0, n - h) * CAST(p.a AS DOUBLE) + h * CAST(p.c AS DOUBLE) + o * CAST(p.b AS DOUBLE)) / 1e6, 0)), 6) AS dollars,
       round(CAST(sum(h) AS DOUBLE) / sum(n), 4) AS cache_ratio FROM r LEFT JOIN p ON r.model = p.model GROUP BY r.model
"""

_OLD = """concat('{"a": "', p_size, '", "o": {"x": "1", "z": ["q"]}, "l": ["', p_brand, '", "s"]}')"""
_NEW = """concat('{"a": "new", "b": "', p_name, '", "o": {"x": "2", "y": "', p_type, '"}, "l": ["s", "', p_type, '"]}')"""


def deep_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", f"CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE {_OLD} END AS old", f"{_NEW} AS new")
    rows = rows.select("p_partkey", objects.deep_merge(F.col("old"), F.col("new")).alias("m"), objects.member_count(F.col("old")).alias("n_old"))
    get = lambda path: F.get_json_object(F.col("m")["o"], path)
    items = objects.moved_to_end(F.from_json(F.col("m")["l"], "array<string>"), F.lit("s"))
    return rows.select("p_partkey", "n_old", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), get("$.x").alias("x"), get("$.y").alias("y"), F.array_join(items, ",").alias("items"))


DEEP_MERGE = """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 3 END AS n_old, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE CAST(p_size AS VARCHAR) END AS a, p_name AS b,
       CASE WHEN p_partkey % 5 = 0 THEN '2' ELSE '1' END AS x, p_type AS y, CASE WHEN p_partkey % 5 = 0 OR p_brand = p_type THEN p_type ELSE p_brand || ',' || p_type END || ',s' AS items FROM part
"""

QUERIES = {k.lower(): (globals()[k.lower()], v) for k, v in list(globals().items()) if k.isupper() and k[0] != "_" and isinstance(v, str) and callable(globals().get(k.lower()))}
