"""Queries on texts, keys, claims, payloads and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import claims, metrics
from lodestar.plans.inputs import EVENTS_AS_OF, OBSERVATIONS_SQL, event_observations, event_signals
from lodestar.sources.tables import table
from lodestar.streaming import incremental, keyed_state


def length_distribution(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count_if(n < 30).alias("under_30"), F.count_if(n.between(30, 119)).alias("to_119"), F.count_if(n.between(120, 999)).alias("to_999"), F.count_if(n >= 1000).alias("from_1000"))


LENGTH_DISTRIBUTION = """
SELECT lang, count(*) FILTER (WHERE length(text) < 30) AS under_30, count(*) FILTER (WHERE length(text) BETWEEN 30 AND 119) AS to_119,
       count(*) FILTER (WHERE length(text) BETWEEN 120 AND 999) AS to_999, count(*) FILTER (WHERE length(text) >= 1000) AS from_1000 FROM documents GROUP BY lang
"""


def percentiles_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(
        F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY n_chars) FILTER (WHERE lang = 'en')").alias("median_en"),
        F.expr("percentile_cont(0.9) WITHIN GROUP (ORDER BY n_chars)").alias("p90"), F.count_if(F.col("lang") == "en").alias("n_en"))


PERCENTILES_FILTERED = "SELECT source, quantile_cont(n_chars, 0.5) FILTER (WHERE lang = 'en') AS median_en, quantile_cont(n_chars, 0.9) AS p90, count(*) FILTER (WHERE lang = 'en') AS n_en FROM documents GROUP BY source"


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five documents of each language, by a hash of their id: sampling is the feature."""
    w = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return table(spark, d, "documents").select("lang", "doc_id").withColumn("rank", F.row_number().over(w)).where("rank <= 5")


STRATIFIED_SAMPLE = "SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM documents) WHERE rank <= 5"

CLEAN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(coalesce({c}, ''),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&'),
  '<[^>]+>', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'), '(!)!!+|(\?)\?\?+|(\.)\.\.+|(,),,+', '\1\2\3\4', 'g'), '\s+', ' ', 'g'))"""


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    c = text.clean_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(c).alias("clean_md5"), (F.length(c) > 0).alias("any"))


CLEAN_TEXT = "WITH c AS (SELECT page_id, " + CLEAN_SQL.replace("{c}", "html") + r" AS c FROM pages) SELECT page_id, md5(c) AS clean_md5, length(c) > 0 AS any FROM c"


def lang_keyword(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.keyword_language(F.col("text")).alias("language"))


_SCORES = {k: " + ".join(f"CAST(contains(t, ' {w} ') AS INT)" for w in ws) for k, ws in text.LANGUAGE_WORDS.items()}
LANG_KEYWORD = (
    "WITH t AS (SELECT doc_id, ' ' || lower(coalesce(text, '')) || ' ' AS t FROM documents), s AS (SELECT doc_id, "
    + ", ".join(f"{v} AS n_{k}" for k, v in _SCORES.items()) + " FROM t), b AS (SELECT *, greatest(" + ", ".join(f"n_{k}" for k in _SCORES) + ") AS best FROM s) SELECT doc_id, CASE WHEN best = 0 THEN NULL "
    + " ".join(f"WHEN n_{k} = best THEN '{k}'" for k in _SCORES) + " END AS language FROM b"
)


def informative_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.informative(text.clean_text(F.col("text"))).alias("informative"))


INFORMATIVE_FILTER = "WITH c AS (SELECT conv_id, turn, " + CLEAN_SQL.replace("{c}", "text") + r""" AS c FROM conversations), n AS (SELECT *, len(regexp_extract_all(c, '[A-Za-zÀ-ÿ]{3,}')) AS n FROM c)
SELECT conv_id, turn, length(c) >= 10 AND n >= 3 AND NOT (n <= 3 AND regexp_matches(lower(c), '\b(merci|thanks|gracias|super|great|nice|good|endroit|place|sitio|spot)\b')) AS informative FROM n"""


def normalize_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.extract_domain(F.col("url")).alias("domain"))


NORMALIZE_DOMAIN = (
    r"WITH x AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^.*?://', ''), '[/?#].*$', ''), '^www\.', ''), '.') AS s FROM pages) "
    + "SELECT page_id, CASE WHEN s <> '' AND contains(s, '.') AND NOT (" + " OR ".join(f"contains(s, '{x}')" for x in text.AGGREGATOR_DOMAINS + text.SHARED_DOMAINS) + ") THEN s END AS domain FROM x"
)


def normalize_phone(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("+34 91-"), k, F.lit(" 45"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("0034 (91) "), k)).otherwise(k)
    return table(spark, d, "customer").select("c_custkey", text.normalize_phone(raw).alias("phone"))


NORMALIZE_PHONE = """
WITH r AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+34 91-' || c_custkey || ' 45' WHEN 1 THEN '0034 (91) ' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS raw FROM customer),
d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS g FROM r),
e AS (SELECT *, CASE WHEN starts_with(raw, '00') THEN substr(g, 3) ELSE g END AS h FROM d)
SELECT c_custkey, CASE WHEN length(h) >= 6 THEN CASE WHEN starts_with(raw, '+') OR starts_with(raw, '00') THEN '+' ELSE '' END || h END AS phone FROM e
"""


def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(text.trigram_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


def _trigrams_sql(c: str) -> str:
    return (f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> ''), "
            "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))")


TRIGRAM_SIMILARITY = f"""
WITH t AS (SELECT p_partkey, {_trigrams_sql('p_name')} AS a, {_trigrams_sql('p_type')} AS b FROM part)
SELECT p_partkey, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS similarity FROM t
"""


def jaccard_neardup(spark: SparkSession, d: str) -> DataFrame:
    """Similar turns of one conversation: pairs within a conversation, as of reviews within a place."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.token_set(F.col("text")).alias("tokens"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") < F.col("b.turn")))
    score = text.set_similarity(F.col("a.tokens"), F.col("b.tokens"))
    return pairs.where(score >= 0.1).select("a.conv_id", F.col("a.turn").alias("turn_a"), F.col("b.turn").alias("turn_b"), F.round(score, 6).alias("similarity"))


JACCARD_NEARDUP = r"""
WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+'), lambda w: length(w) > 2)) AS k FROM conversations),
p AS (SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, len(list_intersect(a.k, b.k)) AS i, len(list_distinct(list_concat(a.k, b.k))) AS u FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn)
SELECT conv_id, turn_a, turn_b, round(CAST(i AS DOUBLE) / u, 6) AS similarity FROM p WHERE u > 0 AND CAST(i AS DOUBLE) / u >= CAST(0.1 AS DOUBLE)
"""


def grounding_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether each turn is grounded in the turn before it."""
    rows = table(spark, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.where("before IS NOT NULL").select("conv_id", "turn", claims.grounding(F.col("text"), F.col("before")).alias("grounded"))


GROUNDING_OVERLAP = r"""
WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+'), lambda w: length(w) >= 4) AS k, text FROM conversations),
p AS (SELECT *, lag(k) OVER w AS q, lag(text) OVER w AS bt FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN len(k) > 0 THEN CAST(len(list_filter(k, lambda x: list_contains(q, x))) AS DOUBLE) / len(k) >= CAST(0.34 AS DOUBLE) ELSE false END AS grounded FROM p WHERE bt IS NOT NULL
"""

#: A small vocabulary of words that the documents hold.
RULES = (
    claims.Rule("article", "true", 0.8, ("the", "der", "les", "pas de")), claims.Rule("article", "false", 0.7, ("und", "que")),
    claims.Rule("overnight_safe", "true", 0.8, ("with", "von")), claims.Rule("overnight_safe", "false", 0.9, ("trash", "idiot")),
    claims.Rule("police_risk", "0.85", 0.9, ("that",)), claims.Rule("spot_closed", "true", 0.9, ("worthless", "closed")),
)


def lexical_claims(spark: SparkSession, d: str) -> DataFrame:
    return claims.extract_claims(table(spark, d, "documents"), RULES, key="doc_id").select("doc_id", "signal", "value", "confidence")


LEXICAL_CLAIMS = rf"""
WITH r(signal, value, confidence, needle) AS (VALUES {', '.join(f"('{r.signal}', '{r.value}', {r.confidence}, '{n}')" for r in RULES for n in r.needles)}),
c AS (SELECT doc_id, list_filter(string_split_regex(unnest(string_split_regex(lower(text), '[.!?;:
,]')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM c),
m AS (SELECT DISTINCT doc_id, w[p] AS needle FROM i WHERE w[p] IN (SELECT needle FROM r) AND NOT list_has_any(w[greatest(1, p - 3):p - 1], [{', '.join(f"'{n}'" for n in claims.NEGATIONS)}])
  UNION SELECT doc_id, 'pas de' FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])pas de($|[^\p{{L}}\p{{N}}_])')),
k AS (SELECT DISTINCT doc_id, signal, value, CAST(confidence AS DOUBLE) AS confidence FROM m JOIN r USING (needle) WHERE signal <> 'police_risk')
SELECT * FROM k WHERE NOT (signal = 'overnight_safe' AND value = 'true' AND doc_id IN (SELECT doc_id FROM k WHERE signal = 'overnight_safe' AND value = 'false'))
"""


#: Rules and needles of the vocabulary that the documents themselves give.
N_RULES, N_NEEDLES = 60, 764


def vocabulary_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims by a vocabulary of full size: the documents' most frequent words, dealt to rules by rank."""
    docs = table(spark, d, "documents")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{4,}\b"), F.lit(0))).alias("needle")).groupBy("needle").count()
    top = words.orderBy(F.desc("count"), "needle").limit(N_NEEDLES)
    ranked = top.select("needle", (F.row_number().over(Window.orderBy(F.desc("count"), "needle")) - 1).alias("at"))  # N_NEEDLES rows
    rule = (F.col("at") % N_RULES).alias("rule")
    rules = claims.rules_of(ranked.select(rule, "at", F.concat(F.lit("s"), rule % (N_RULES // 2)).alias("signal"),
                                          F.when(rule < N_RULES // 2, "true").otherwise("false").alias("value"), F.lit(0.8).alias("confidence"), "needle"))
    found = claims.extract_claims(docs.where("doc_id IS NOT NULL"), rules, key="doc_id", around=20)
    return found.select("doc_id", "signal", "value", "needle", "excerpt")


VOCABULARY_CLAIMS = rf"""
WITH v AS (SELECT w AS needle, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS rk FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents) WHERE regexp_full_match(w, '[a-z]{{4,}}') GROUP BY w QUALIFY rk < {N_NEEDLES}),
c AS (SELECT doc_id, list_filter(string_split_regex(unnest(string_split_regex(lower(text), '[.!?;:
,]')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM c),
m AS (SELECT DISTINCT doc_id, w[p] AS needle FROM i WHERE w[p] IN (SELECT needle FROM v) AND (w[p] IN ('{"', '".join(n for n in claims.NEGATIONS)}') OR NOT list_has_any(w[greatest(1, p - 3):p - 1], [{', '.join(f"'{n}'" for n in claims.NEGATIONS)}]))),
k AS (SELECT doc_id, rk % {N_RULES} AS rule, arg_min(needle, rk) AS needle FROM m JOIN v USING (needle) GROUP BY 1, 2)
SELECT doc_id, 's' || (rule % {N_RULES // 2}) AS signal, CASE WHEN rule < {N_RULES // 2} THEN 'true' ELSE 'false' END AS value, needle,
  trim(substr(lower(text), greatest(1, position(needle IN lower(text)) - 20), position(needle IN lower(text)) - greatest(1, position(needle IN lower(text)) - 20) + length(needle) + 20)) AS excerpt
FROM k JOIN documents USING (doc_id)
"""


def kebab_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(text.kebab(F.concat(F.col("p_name"), F.lit(" _"), F.col("p_type"))).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


KEBAB_TAGS = r"""
SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name || ' _' || p_type)), '[_/\s]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '-') AS tag, count(*) AS n FROM part GROUP BY 1
"""


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return metrics.token_budget(rows, "conv_id", [F.col("turn")], text.estimate_tokens(F.coalesce("text", F.lit(""))), 200).select("conv_id", "turn", "tokens", "total")


TOKEN_BUDGET = """
WITH t AS (SELECT conv_id, turn, greatest(1, length(coalesce(text, '')) // 4) AS tokens FROM conversations),
s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM t)
SELECT conv_id, turn, tokens, total FROM s WHERE total <= 200 OR rn = 1
"""


def embedding_drift(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose fingerprint isn't the one that their embedding was built from, or that have none."""
    docs = table(spark, d, "documents").select("doc_id", F.substring(F.sha1(F.concat_ws("|", "lang", "source", F.coalesce("text", F.lit("")))), 1, 16).alias("fingerprint"))
    built = docs.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("fingerprint")).alias("built_from"))
    return docs.join(built, "doc_id", "left").where(~F.col("fingerprint").eqNullSafe(F.col("built_from"))).select("doc_id", "fingerprint", F.col("built_from").isNull().alias("missing"))


EMBEDDING_DRIFT = """
SELECT doc_id, left(sha1(concat_ws('|', lang, source, coalesce(text, ''))), 16) AS fingerprint, doc_id % 3 = 0 AS missing FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0
"""

_FILLED = "concat(coalesce(text, ''), CASE turn % 4 WHEN 0 THEN ' Thank you to the town for this. Highly recommended!' WHEN 1 THEN ' Sin duda volveremos a este sitio! 10 / 10. Via: web' WHEN 2 THEN ' ÉTOILES, merci à la mairie' ELSE '' END)"


def trim_filler(spark: SparkSession, d: str) -> DataFrame:
    """Turns without filler, and what share of each went."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_FILLED).alias("t"))
    rows = rows.withColumn("out", text.without_filler(F.col("t")))
    ratio = F.when(F.length("t") > 0, 1.0 - F.length("out") / F.length("t")).otherwise(0.0)
    return rows.select("conv_id", "turn", F.md5("out").alias("trimmed_md5"), F.round(ratio, 6).alias("ratio"))


def _filler_sql() -> str:
    cut = "t"
    for pattern in text.FILLER:
        cut = f"regexp_replace({cut}, '(?i){pattern.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    return cut


TRIM_FILLER = rf"""
WITH s AS (SELECT conv_id, turn, {_FILLED} AS t FROM conversations), c AS (SELECT *, trim(regexp_replace({_filler_sql()}, '\s{{2,}}', ' ', 'g')) AS cut FROM s),
o AS (SELECT *, CASE WHEN length(t) <= 40 THEN t WHEN length(cut) < 40 THEN trim(t) ELSE cut END AS o FROM c)
SELECT conv_id, turn, md5(o) AS trimmed_md5, round(CASE WHEN length(t) > 0 THEN 1 - CAST(length(o) AS DOUBLE) / length(t) ELSE 0 END, 6) AS ratio FROM o
"""

def stream_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a stream's table and checkpoint, in the folder that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='lodestar-stream-')}"
    return f"{base.rstrip('/')}/{name}"


def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the events read as a stream of files, equal to the batch's."""
    from lodestar.sources.streams import stream_table

    events = stream_table(spark, d, "events")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    rows = events.select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("signal"), F.col("value").alias("value_num"),
                         (F.when(k != "", k).cast("double") / 100).alias("weight"), F.col("ts").cast("timestamp").alias("observed_at"))
    return incremental.run_once(incremental.stream_scores(rows, 30.0, EVENTS_AS_OF), ["entity_id", "signal"], stream_folder(spark, f"stream_state_{uuid.uuid4().hex}"))


def stream_keyed_state(spark: SparkSession, d: str) -> DataFrame:
    """The batch state of the events, with half-lives and boost, kept up to date by the events as a stream."""
    from lodestar.sources.streams import stream_table

    rows = event_observations(spark, d, stream_table(spark, d, "events"))
    with keyed_state.settings(spark):
        states = keyed_state.entity_states(rows, event_signals(spark, d, "numeric"), clock=EVENTS_AS_OF)
        table = incremental.run_once(states, ["entity_id", "signal"], stream_folder(spark, f"stream_keyed_{uuid.uuid4().hex}"))
    return keyed_state.scores_at(table, EVENTS_AS_OF).select("entity_id", "signal", F.col("score_num").alias("score"), "confidence", "support", "n_observations")


STREAM_KEYED_STATE = f"""
WITH {OBSERVATIONS_SQL}
SELECT entity_id, signal, round(sum(value * w) / sum(w), 6) AS score, round(least(1, sum(w) / 5), 6) AS confidence, round(sum(w), 6) AS support, count(*) AS n_observations
FROM obs GROUP BY entity_id, signal HAVING sum(w) > 0
"""

STREAM_STATE = """
WITH o AS (SELECT user_id AS entity_id, event_type AS signal, value, CAST(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS DOUBLE) / 100
  * pow(CAST(0.5 AS DOUBLE), CAST(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 86400e6 / 30) AS w FROM events)
SELECT entity_id, signal, round(sum(value * w) / sum(w), 6) AS score, count(*) AS n FROM o GROUP BY ALL HAVING sum(w) > 0
"""


def batch_state(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of stream_state, of two halves merged."""
    obs = event_observations(spark, d)
    half = lambda k: incremental.decayed_sums(obs.where(F.col("ord") % 2 == k), 30.0, EVENTS_AS_OF)
    return incremental.scores(incremental.merged_sums(half(0), half(1)))


BATCH_STATE = STREAM_STATE

QUERIES = {k.lower(): (globals()[k.lower()], v) for k, v in list(globals().items()) if k.isupper() and isinstance(v, str) and callable(globals().get(k.lower()))}
