"""Queries over files that Spark writes from the tables and reads back: extracts and archives of places."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import archive_places as archived
from lodestar.operators import places
from lodestar.plans.text_queries import stream_folder
from lodestar.sources import archives, osm_pbf
from lodestar.sources.tables import table


def _tags(key: Column) -> Column:
    pairs = ((0, ("amenity", "fuel", "shop", "supermarket")), (1, ("amenity", "bench", "tourism", "viewpoint")), (2, ("natural", "beach", "name", "Küste")),
             (4, ("shop", "bakery")), (5, ("name", "x", "amenity", "drinking_water")))
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(*[F.when(key % 6 == i, F.create_map(*map(F.lit, p))) for i, p in pairs], empty)


def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    """Customers as nodes, orders as ways over up to three nodes, some of which are missing."""
    key = F.col("c_custkey")
    nodes = table(spark, d, "customer").select(F.lit("node").alias("kind"), key.alias("id"), ((key * 104729 % 36000 - 18000) * 100000).alias("lon_e7"),
                                               ((key * 7919 % 12000 - 6000) * 100000).alias("lat_e7"), _tags(key).alias("tags"), F.lit(None).cast("array<bigint>").alias("refs"))
    none, cust = F.lit(None).cast("bigint"), F.col("o_custkey").cast("bigint")
    ways = table(spark, d, "orders").select(F.lit("way").alias("kind"), F.col("o_orderkey").alias("id"), none.alias("lon_e7"), none.alias("lat_e7"),
                                            _tags(F.col("o_orderkey")).alias("tags"), F.array(cust, cust * 7 % 20011, cust).alias("refs"))
    return nodes.unionByName(ways)


def osm_extract(spark: SparkSession, d: str) -> DataFrame:
    """Places of an extract that is written and read back as PBF."""
    osm_pbf.register(spark)
    folder = stream_folder(spark, f"extract_{uuid.uuid4().hex}")
    extract_entities(spark, d).write.format("osm_pbf").mode("append").save(folder)
    return places.extract_places(osm_pbf.extract(spark, folder))


OSM_EXTRACT = """
WITH n AS (SELECT CAST(c_custkey AS BIGINT) AS id, (c_custkey * 104729 % 36000 - 18000) * 100000 AS x, (c_custkey * 7919 % 12000 - 6000) * 100000 AS y FROM customer),
w AS (SELECT CAST(o_orderkey AS BIGINT) AS id, unnest([CAST(o_custkey AS BIGINT), CAST(o_custkey AS BIGINT) * 7 % 20011, CAST(o_custkey AS BIGINT)]) AS ref FROM orders),
c(i, category) AS (VALUES (0, 'fuel'), (1, 'viewpoint'), (2, 'beach'), (4, 'bakery'), (5, 'drinking_water'))
SELECT category, 'node' AS osm_type, id AS osm_id, CAST(x AS DOUBLE) / CAST(1e7 AS DOUBLE) AS lon, CAST(y AS DOUBLE) / CAST(1e7 AS DOUBLE) AS lat FROM n JOIN c ON id % 6 = i
UNION ALL
SELECT category, 'way', w.id, CAST(sum(x) AS DOUBLE) / CAST(count(*) AS DOUBLE) / CAST(1e7 AS DOUBLE), CAST(sum(y) AS DOUBLE) / CAST(count(*) AS DOUBLE) / CAST(1e7 AS DOUBLE)
FROM w JOIN n ON n.id = w.ref JOIN c ON w.id % 6 = i GROUP BY category, w.id
"""

def archive_places(spark: SparkSession, d: str) -> DataFrame:
    """Places of archives that are written and read back: parts as zipped lines, customers as Placemarks; some have no place."""
    archives.register(spark)
    folder = stream_folder(spark, f"archives_{uuid.uuid4().hex}")
    key, cust = F.col("p_partkey"), F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, (*archived.STOP_TYPES, "ZZ"))), (key % 9 + 1).cast("int"))
    code = F.when(key % 3 == 0, F.concat(F.lit("  ("), key.cast("string"), F.lit(" )"))).otherwise("")
    said = F.concat(kind, F.lit(" PAYS-BAS "), F.upper("p_name"), code, F.when(key % 11 == 0, " Aire").otherwise(" Aire CCI "), key.cast("string"))
    line = F.concat_ws(",", (key * 7 % 400 - 200).cast("string"), (key * 3 % 90).cast("string"), F.concat(F.lit('"'), said, F.lit('"')))
    table(spark, d, "part").select(line.alias("line")).write.format("place_archive").mode("append").save(folder)
    marks = table(spark, d, "customer").select(
        ((cust * 104729 % 40000 - 20000) / 100.0).alias("lon"), ((cust * 7919 % 12000 - 6000) / 100.0).alias("lat"), F.when(cust % 4 != 0, F.col("c_name")).alias("name"),
        F.concat(F.lit(" <b>"), F.col("c_mktsegment"), F.lit("</b> & more ")).alias("description"), F.concat(F.lit("#s"), (cust % 5).cast("string")).alias("style"))
    marks.write.format("place_archive").mode("append").save(folder)
    found = archived.archive_places(spark.read.format("place_archive").load(folder))
    return found.drop("archive").withColumn("name", F.lower("name"))


ARCHIVE_PLACES = """
WITH p AS (SELECT *, ['AC', 'ACF', 'ACS', 'APCC', 'APN', 'AS', 'ASN', 'AA', 'ZZ'][p_partkey % 9 + 1] AS k, p_partkey * 7 % 400 - 200 AS x, p_partkey * 3 % 90 AS y FROM part),
q AS (SELECT *, k || ' PAYS-BAS ' || upper(p_name) || CASE WHEN p_partkey % 3 = 0 THEN '  (' || p_partkey || ' )' ELSE '' END || ' Aire CCI ' || p_partkey AS said
  FROM p WHERE p_partkey % 11 <> 0 AND x BETWEEN -180 AND 180 AND NOT (x = 0 AND y = 0)),
c AS (SELECT *, CAST(c_custkey * 104729 % 40000 - 20000 AS DOUBLE) / CAST(100 AS DOUBLE) AS x, CAST(c_custkey * 7919 % 12000 - 6000 AS DOUBLE) / CAST(100 AS DOUBLE) AS y FROM customer)
SELECT CAST(p_partkey AS VARCHAR) AS source_id, lower(p_name) || CASE WHEN p_partkey % 3 = 0 THEN ' (' || p_partkey || ')' ELSE '' END AS name, CAST(y AS DOUBLE) AS lat, CAST(x AS DOUBLE) AS lon,
  CASE WHEN k IN ('AC', 'APCC', 'AS', 'AA') THEN 'area_ac' WHEN k IN ('ACF', 'ACS') THEN 'camping' WHEN k = 'APN' THEN 'parking_privado' WHEN k = 'ASN' THEN 'parking_publico' ELSE 'otro' END AS type,
  CASE WHEN k IN ('AC', 'ASN') THEN true WHEN k IN ('APCC', 'APN') THEN false END AS free, 'PAYS-BAS' AS country, said AS description FROM q
UNION ALL
SELECT printf('%.6f_%.6f', y, x), CASE WHEN c_custkey % 4 = 0 THEN 'sin nombre' ELSE lower(c_name) END, y, x, '#s' || c_custkey % 5, NULL, NULL, '<b>' || c_mktsegment || '</b> & more'
FROM c WHERE x BETWEEN -180 AND 180
"""

QUERIES = {"osm_extract": (osm_extract, OSM_EXTRACT), "archive_places": (archive_places, ARCHIVE_PLACES)}
