"""Queries on records of many sources: votes, upserts, keys, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import decay, text
from lodestar.operators import metrics, reconcile, state, vehicles
from lodestar.plans.inputs import ORDERS_AS_OF
from lodestar.sources.tables import table


def _values(spark: SparkSession, d: str) -> DataFrame:
    """Line items as source records: the order is the entity, the supplier the source, the flag the value."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("entity_id"), F.lit("returnflag").alias("field"), F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("value"),
        F.lit(None).cast("int").alias("source_rank"), (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).cast("long").alias("record_id"))


def _credibility(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("source"), ((F.col("s_suppkey") % 50 + 50) / 100.0).alias("base_score"))


VOTE_SQL = """
v0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber DESC, l_returnflag DESC) AS rn FROM lineitem),
v AS (SELECT l_orderkey AS entity_id, l_suppkey AS source, l_returnflag AS value, l_linenumber * 1000000 + l_suppkey AS record_id,
      CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_suppkey % 50 + 50 AS DOUBLE) / 100 ELSE CAST(0.5 AS DOUBLE) END AS w FROM v0 WHERE rn = 1),
g AS (SELECT entity_id, value, sum(w) AS weight, count(*) AS supporters, arg_min(source, record_id) AS witness FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY weight DESC, value DESC) AS rn, sum(weight) OVER (PARTITION BY entity_id) AS total,
      coalesce(lead(weight) OVER (PARTITION BY entity_id ORDER BY weight DESC, value DESC), 0) AS second, count(*) OVER (PARTITION BY entity_id) AS n FROM g),
b AS (SELECT *, (weight - second) / total AS m, round((weight - second) / total, 9) < CAST(0.1 AS DOUBLE) AS tie FROM r WHERE rn = 1)"""


def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    out = reconcile.weighted_vote(_values(spark, d), _credibility(spark, d))
    return out.select("entity_id", "value", F.col("witness").cast("string").alias("witness"), "confidence", "conflict", "decision")


WEIGHTED_VOTE = f"""
WITH {VOTE_SQL}
SELECT entity_id, CASE WHEN NOT tie THEN value END AS value, CASE WHEN NOT tie THEN CAST(witness AS VARCHAR) END AS witness, round(weight / total, 6) AS confidence,
       n > 1 AS conflict, CASE WHEN tie THEN 'keep_existing' ELSE 'set' END AS decision FROM b
"""


def vote_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.conflicts(_values(spark, d)).select("entity_id", "n_values")


VOTE_CONFLICTS = "SELECT l_orderkey AS entity_id, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1"


def rank_first(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("entity_id"), F.lit("status").alias("field"), F.col("l_suppkey").alias("source"), F.col("l_linestatus").alias("value"),
        F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey")).cast("int").alias("source_rank"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"))
    return reconcile.rank_first(values).select("entity_id", "value", "witness")


RANK_FIRST = """
SELECT entity_id, value, witness FROM (
  SELECT l_partkey AS entity_id, l_linestatus AS value, l_suppkey AS witness,
         row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey ELSE 1073741824 END, l_orderkey * 10 + l_linenumber) AS rn FROM lineitem) WHERE rn = 1
"""


def provenance_coverage(spark: SparkSession, d: str) -> DataFrame:
    votes = reconcile.weighted_vote(_values(spark, d), _credibility(spark, d)).withColumn("field", F.concat(F.lit("f"), F.col("entity_id") % 5))
    return metrics.provenance_coverage(votes)


PROVENANCE_COVERAGE = f"""
WITH {VOTE_SQL}
SELECT 'f' || (entity_id % 5) AS field, count(*) AS n, count(*) FILTER (WHERE NOT tie) AS n_decided, count(*) FILTER (WHERE n > 1) AS n_conflicts,
       round(avg(round(weight / total, 6)), 3) AS avg_confidence FROM b GROUP BY 1
"""


def popularity_score(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("spot_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderpriority").alias("source"))
    return metrics.popularity(table(spark, d, "customer").select(F.col("c_custkey").alias("spot_id")), orders, ORDERS_AS_OF)


POPULARITY_SCORE = """
WITH o AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS s, max(o_orderdate) AS last FROM orders GROUP BY 1),
x AS (SELECT c_custkey AS spot_id, coalesce(n, 0) AS n_reviews, coalesce(s, 0) AS n_sources, CASE WHEN last IS NULL THEN CAST(0 AS DOUBLE) WHEN last > TIMESTAMP '2001-12-01' - INTERVAL 90 DAY THEN 1
  WHEN last > TIMESTAMP '2001-12-01' - INTERVAL 365 DAY THEN 0.7 WHEN last > TIMESTAMP '2001-12-01' - INTERVAL 730 DAY THEN 0.3 ELSE 0.1 END AS rec FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT spot_id, n_reviews, n_sources, round(CAST(0.5 AS DOUBLE) * least(ln(CAST(1 + n_reviews AS DOUBLE)) / ln(CAST(51 AS DOUBLE)), 1) + CAST(0.3 AS DOUBLE) * least(ln(CAST(1 + n_sources AS DOUBLE)) / ln(CAST(5 AS DOUBLE)), 1) + CAST(0.2 AS DOUBLE) * rec, 3) AS popularity FROM x
"""


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(popularity_score(spark, d), "popularity")


SCORE_HISTOGRAM = f"SELECT round(popularity, 1) AS bucket, count(*) AS n FROM ({POPULARITY_SCORE}) GROUP BY 1"


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.count_if(F.col("o_totalprice") > 100000).alias("n_large"),
                 F.count_distinct(F.when(F.col("o_orderstatus") == "O", F.col("o_custkey"))).alias("open_customers"),
                 metrics.percentage(F.col("o_orderpriority") == "1-URGENT").alias("pct_urgent"))


DASHBOARD = """
SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_totalprice > 100000) AS n_large,
       count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'O') AS open_customers,
       round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') * CAST(100 AS DOUBLE) / nullif(count(*), 0), 2) AS pct_urgent FROM orders
"""


def country_eligibility(spark: SparkSession, d: str) -> DataFrame:
    n, c, o = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "orders")
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price"))
    joined = n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy(F.upper("n_name").alias("country")).agg(
        F.count("c_custkey").alias("spots"), F.count_if(F.col("n_orders") >= 3).alias("eligible"), F.count_if(F.col("c_custkey").isNotNull() & F.col("n_orders").isNull()).alias("without"),
        F.round(F.avg(F.when(F.col("n_orders") >= 3, F.col("mean_price"))), 2).alias("mean_price"))


COUNTRY_ELIGIBILITY = """
WITH p AS (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1)
SELECT upper(n_name) AS country, count(c_custkey) AS spots, count(*) FILTER (WHERE n_orders >= 3) AS eligible, count(*) FILTER (WHERE c_custkey IS NOT NULL AND n_orders IS NULL) AS without,
       round(avg(mean_price) FILTER (WHERE n_orders >= 3), 2) AS mean_price
FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN p ON o_custkey = c_custkey GROUP BY 1
"""


def source_stats_mv(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return metrics.source_stats(docs.select("source", "doc_id", "n_chars"), docs.select("source", "doc_id").join(labels, "doc_id").select("source", "toxic", "quality"))


SOURCE_STATS_MV = """
WITH a AS (SELECT source, count(*) AS n_records, sum(n_chars) AS total_chars, max(n_chars) AS longest FROM documents GROUP BY 1),
b AS (SELECT source, count(*) AS n_labelled, sum(toxic) AS n_toxic, sum(quality) AS n_good FROM documents JOIN labels USING (doc_id) GROUP BY 1),
s AS (SELECT source FROM a UNION SELECT source FROM b)
SELECT source, coalesce(n_records, 0) AS n_records, coalesce(total_chars, 0) AS total_chars, longest, coalesce(n_labelled, 0) AS n_labelled, coalesce(n_toxic, 0) AS n_toxic, coalesce(n_good, 0) AS n_good
FROM s LEFT JOIN a USING (source) LEFT JOIN b USING (source)
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def union_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.labelled_counts({t: table(spark, d, t) for t in TABLES})


UNION_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES)


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return metrics.duplicate_groups(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("key")))


DUPLICATE_GROUPS = """
SELECT p_name AS key, count(*) AS n, list_aggregate(list_sort(list(p_partkey))[1:10], 'string_agg', ',') AS first_ids FROM part WHERE p_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1
"""


def duplicate_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_groups(spark, d).groupBy(F.col("n").alias("group_size")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"))


DUPLICATE_GROUP_SIZES = "WITH g AS (SELECT count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1) SELECT n AS group_size, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM g GROUP BY 1"


def array_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(F.array("source", "lang")).alias("item")).groupBy("item").count().withColumnRenamed("count", "n")


ARRAY_GROUP = "SELECT item, count(*) AS n FROM (SELECT unnest([source, lang]) AS item FROM documents) GROUP BY 1"


def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "source")


SEMI_EXISTS = "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)"


def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


ANTI_MISSING = "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


def double_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o, s = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "supplier")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").join(s, c["c_custkey"] == s["s_suppkey"], "left_anti").select("c_custkey")


DOUBLE_ANTI = "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey)"


def at_least_n_new(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderdate") > F.lit("2001-01-01").cast("timestamp")).alias("n_new")).where("n_new >= 2")


AT_LEAST_N_NEW = "SELECT o_custkey, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '2001-01-01') AS n_new FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderdate > TIMESTAMP '2001-01-01') >= 2"


def candidate_priority(spark: SparkSession, d: str) -> DataFrame:
    spots = table(spark, d, "customer").select(F.col("c_custkey").alias("spot_id"), (F.col("c_acctbal") > 0).alias("active"),
                                               F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 4).cast("int").alias("version"), (F.col("c_custkey") % 5 == 0).alias("stale"),
                                               F.when(F.col("c_custkey") % 3 != 0, F.lit("2000-06-01").cast("timestamp")).alias("aggregated_at"))
    reviews = table(spark, d, "orders").select(F.col("o_custkey").alias("spot_id"), F.col("o_orderdate").cast("timestamp").alias("first_seen"))
    return metrics.enrichment_candidates(spots, reviews, 3, ORDERS_AS_OF, 200).select("spot_id", "n_reviews", "version_behind", "stale")


CANDIDATE_PRIORITY = """
WITH s AS (SELECT c_custkey AS spot_id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 END AS version, c_custkey % 5 = 0 AS stale,
           CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2000-06-01' END AS at_ FROM customer WHERE c_acctbal > 0),
r AS (SELECT spot_id, version, stale, at_, count(*) AS n_reviews, count(*) FILTER (WHERE o_orderdate > at_) AS n_new FROM s JOIN orders ON o_custkey = spot_id GROUP BY ALL),
c AS (SELECT *, coalesce(version < 3, false) AS version_behind FROM r WHERE n_reviews >= 3 AND (version IS NULL OR version < 3 OR stale OR at_ < TIMESTAMP '2001-12-01' - INTERVAL 18 MONTH OR n_new >= 5))
SELECT spot_id, n_reviews, version_behind, stale FROM c ORDER BY version_behind DESC, stale DESC, n_reviews DESC, spot_id LIMIT 200
"""


def age_weight(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", decay.review_age_weight(F.col("o_orderdate").cast("date"), F.lit("2001-12-01").cast("date")).alias("weight"))


AGE_WEIGHT = """
WITH o AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-01') AS n FROM orders)
SELECT o_orderkey, CAST(CASE WHEN n IS NULL THEN 0.3 WHEN n < 365 THEN 1.0 WHEN n < 730 THEN 0.8 WHEN n < 1095 THEN 0.5 WHEN n < 1825 THEN 0.3 ELSE 0.1 END AS DOUBLE) AS weight FROM o
"""


def month_round_robin(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return metrics.month_round_robin(rows, "o_custkey", "o_orderdate", "o_orderkey").where("place <= 5").select("o_custkey", "o_orderkey", "place")


MONTH_ROUND_ROBIN = """
WITH m AS (SELECT *, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS mon FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, mon ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rn, mon DESC, o_orderkey) AS place FROM r)
SELECT o_custkey, o_orderkey, place FROM p WHERE place <= 5
"""


def min_wins_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("spot_id"), F.when(F.col("l_linenumber") % 2 == 0, "height").otherwise("length").alias("dimension"),
        (F.col("l_quantity") / 10.0).alias("value"), F.col("l_shipmode" if "l_shipmode" in table(spark, d, "lineitem").columns else "l_returnflag").alias("source"), F.lit(0.7).alias("confidence"))
    return vehicles.tightest_limits(rows, "spot_id", ["height", "length"]).select("spot_id", "height", "height_source", "length", "length_source")


MIN_WINS_LIMITS = """
WITH r AS (SELECT l_partkey AS spot_id, CASE WHEN l_linenumber % 2 = 0 THEN 'height' ELSE 'length' END AS dim, l_quantity / CAST(10 AS DOUBLE) AS value, l_returnflag AS source FROM lineitem),
m AS (SELECT *, row_number() OVER (PARTITION BY spot_id, dim ORDER BY value, source) AS rn FROM r WHERE value > 0)
SELECT spot_id, max(value) FILTER (WHERE dim = 'height') AS height, max(source) FILTER (WHERE dim = 'height') AS height_source,
       max(value) FILTER (WHERE dim = 'length') AS length, max(source) FILTER (WHERE dim = 'length') AS length_source FROM m WHERE rn = 1 GROUP BY 1
"""


def upsert_policies(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    side = lambda rows: rows.groupBy("o_custkey").agg(F.max("o_totalprice").alias("price"), F.min("o_orderstatus").alias("status"), F.count(F.lit(1)).alias("n"), F.max("o_orderpriority").alias("priority"))
    return reconcile.upsert(side(o.where("o_orderkey % 2 = 0")), side(o.where("o_orderkey % 2 = 1")), ["o_custkey"], {"price": "greatest", "status": "keep", "n": "add", "priority": "take"})


UPSERT_POLICIES = """
WITH s AS (SELECT o_custkey, o_orderkey % 2 AS half, max(o_totalprice) AS price, min(o_orderstatus) AS status, count(*) AS n, max(o_orderpriority) AS priority FROM orders GROUP BY ALL),
a AS (SELECT * FROM s WHERE half = 0), b AS (SELECT * FROM s WHERE half = 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, greatest(a.price, b.price) AS price, coalesce(a.status, b.status) AS status, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, coalesce(b.priority, a.priority) AS priority
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey
"""


def cascade_remap(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("old_id"), F.col("o_custkey"))
    keep = orders.groupBy("o_custkey").agg(F.min("old_id").alias("new_id"))
    mapping = orders.join(keep, "o_custkey").where("old_id <> new_id").select("old_id", "new_id")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return reconcile.remap(items, mapping, "l_orderkey", ["l_orderkey", "l_partkey"])


CASCADE_REMAP = """
WITH k AS (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS new_id FROM orders)
SELECT coalesce(new_id, l_orderkey) AS l_orderkey, l_partkey, min(l_quantity) AS l_quantity FROM lineitem LEFT JOIN k ON o_orderkey = l_orderkey GROUP BY ALL
"""


def chained_merges(spark: SparkSession, d: str) -> DataFrame:
    """Items moved along chains of merges: each order of a customer merges into the customer's order before it."""
    orders = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("old_id"))
    mapping = orders.withColumn("new_id", F.lag("old_id").over(Window.partitionBy("o_custkey").orderBy("old_id"))).where("new_id IS NOT NULL").select("old_id", "new_id")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return reconcile.remap(items, reconcile.merge_ends(mapping), "l_orderkey", ["l_orderkey", "l_partkey"])


CHAINED_MERGES = CASCADE_REMAP


def amenity_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("spot_id"), (F.col("l_discount") > 0.05).alias("water"), F.when(F.col("l_linenumber") > 1, F.col("l_linestatus")).alias("surface"),
        F.array("l_returnflag").alias("labels"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus").alias("ord"))
    out = reconcile.merge_amenities(rows, "spot_id", ["water"], ["surface"], ["labels"], "ord")
    return out.select("spot_id", "water", "surface", F.array_join("labels", ",").alias("labels"))


AMENITY_MERGE = """
SELECT l_orderkey AS spot_id, bool_or(l_discount > CAST(0.05 AS DOUBLE)) AS water, arg_min(l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_linestatus)) FILTER (WHERE l_linenumber > 1) AS surface,
       array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS labels FROM lineitem GROUP BY 1
"""


def json_budget(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy(F.date_trunc("month", "ts").cast("date").cast("string").alias("month"), "event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


JSON_BUDGET = """
SELECT CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month, event_type, CAST(sum(CAST(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS BIGINT)) AS BIGINT) AS total,
       count(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '')) AS n FROM events GROUP BY ALL
"""

QUERIES = {k.lower(): (globals()[k.lower()], v) for k, v in list(globals().items()) if k.isupper() and isinstance(v, str) and k.lower() in globals()}
