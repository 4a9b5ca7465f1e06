"""The full detail of every place, with its children written out as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import details
from lodestar.plans.inputs import ORDERS_AS_OF
from lodestar.sources.tables import table


def spot_details(spark: SparkSession, d: str) -> DataFrame:
    """Customers as places; orders as reviews, overrides, provenance and sources."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("spot_id"), F.col("c_name").alias("name"))
    o = table(spark, d, "orders").withColumnsRenamed({"o_custkey": "spot_id", "o_orderkey": "review_id"}).withColumn("date", F.expr("CASE WHEN review_id % 10 > 0 THEN CAST(o_orderdate AS DATE) END"))
    sources = o.groupBy("spot_id", F.col("o_orderpriority").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last_seen"))
    overrides = o.where("review_id % 6 = 0").select("spot_id", F.concat(F.lit("f"), F.col("review_id").cast("string")).alias("field"), F.expr("date_add(date, CAST(review_id % 900 AS INT))").alias("expires_at"))
    provenance = o.groupBy("spot_id", F.col("o_orderpriority").alias("field")).agg((F.count_distinct("o_orderstatus") > 1).alias("conflict"), F.nullif(F.max("review_id") % 100, F.lit(0)).alias("confidence"))
    of = lambda where, text: c.where(where).select("spot_id", F.concat(F.lit(text), F.col("spot_id").cast("string")).alias("summary"))
    out = details.spot_details(c, sources, o.select("spot_id", "review_id", "date"), overrides, provenance, of("spot_id % 3 = 0", "state "), of("spot_id % 2 = 0", "older "), of("spot_id % 5 = 0", "near "), ORDERS_AS_OF)
    said = lambda k, *cs: F.array_join(F.transform(k, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in cs])), ",").alias(k)
    return out.select("spot_id", "name", said("sources", "source", "n", "last_seen"), said("reviews", "review_id", "date"), said("field_overrides", "field", "expires_at"), said("provenance", "field", "conflict", "confidence"),
                      F.col("enrichment.summary").alias("enrichment"), "enrichment_source", F.col("geo.summary").alias("geo"))


SPOT_DETAILS = f"""
WITH o AS (SELECT o_custkey AS spot_id, o_orderkey AS review_id, o_orderpriority, o_orderstatus, CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders),
s AS (SELECT spot_id, o_orderpriority AS source, count(*) AS n, max(date) AS last_seen, count(DISTINCT o_orderstatus) > 1 AS conflict, nullif(max(review_id) % 100, 0) AS confidence FROM o GROUP BY 1, 2),
s1 AS (SELECT spot_id, string_agg(concat_ws(':', source, n, last_seen), ',' ORDER BY source) AS sources, string_agg(concat_ws(':', source, conflict, confidence), ',' ORDER BY conflict DESC, confidence ASC NULLS LAST, source) AS provenance FROM s GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY date DESC NULLS LAST, review_id) AS rn FROM o),
r1 AS (SELECT spot_id, string_agg(concat_ws(':', review_id, date), ',' ORDER BY rn) AS reviews FROM r WHERE rn <= {details.MOST_REVIEWS} GROUP BY 1),
f AS (SELECT spot_id, 'f' || review_id AS field, date + CAST(review_id % 900 AS INTEGER) AS expires_at FROM o WHERE review_id % 6 = 0),
f1 AS (SELECT spot_id, string_agg(field || ':' || expires_at, ',' ORDER BY expires_at DESC, field) AS field_overrides FROM f WHERE expires_at > DATE '{ORDERS_AS_OF:%Y-%m-%d}' GROUP BY 1)
SELECT c_custkey AS spot_id, c_name AS name, coalesce(sources, '') AS sources, coalesce(reviews, '') AS reviews, coalesce(field_overrides, '') AS field_overrides, coalesce(provenance, '') AS provenance,
  CASE WHEN c_custkey % 3 = 0 THEN 'state ' || c_custkey WHEN c_custkey % 2 = 0 THEN 'older ' || c_custkey END AS enrichment, CASE WHEN c_custkey % 3 = 0 THEN 'state' WHEN c_custkey % 2 = 0 THEN 'enrichment' END AS enrichment_source,
  CASE WHEN c_custkey % 5 = 0 THEN 'near ' || c_custkey END AS geo
FROM customer LEFT JOIN s1 ON s1.spot_id = c_custkey LEFT JOIN r1 ON r1.spot_id = c_custkey LEFT JOIN f1 ON f1.spot_id = c_custkey
"""

QUERIES = {"spot_details": (spot_details, SPOT_DETAILS)}
