"""Queries on places, vectors and reports of search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import geo
from lodestar.operators import dense_places, search, vehicles
from lodestar.plans.inputs import customers, haversine_sql, place_sql, suppliers
from lodestar.sources.tables import table

CUSTOMERS = f"c AS (SELECT *, {place_sql('c_custkey')} FROM customer)"
SUPPLIERS = f"s AS (SELECT *, {place_sql('s_suppkey')} FROM supplier)"
ANCHOR = "anchor AS (SELECT CAST(10 AS DOUBLE) AS lat, CAST(20 AS DOUBLE) AS lon)"


def bbox_search(spark: SparkSession, d: str) -> DataFrame:
    rows = search.bbox_search(customers(spark, d), -30, -60, 30, 60, 100, "c_acctbal", "c_custkey")
    return rows.select("c_custkey", "lat", "lon", "c_acctbal", "total", "truncated")


BBOX_SEARCH = f"""
WITH {CUSTOMERS}, i AS (SELECT *, count(*) OVER () AS total FROM c WHERE lat BETWEEN -30 AND 30 AND lon BETWEEN -60 AND 60)
SELECT c_custkey, lat, lon, c_acctbal, total, total > 100 AS truncated FROM i ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 100
"""


def radius_search(spark: SparkSession, d: str) -> DataFrame:
    rows = customers(spark, d).where(F.col("c_mktsegment").isNotNull())
    found = search.radius_search(search.faceted(rows.withColumn("rating", F.col("c_acctbal")), min_rating=0.0), 10.0, 20.0, 2500.0, None, "c_custkey")
    return found.select("c_custkey", "c_mktsegment", F.round("dist_km", 4).alias("dist_km"))


RADIUS_SEARCH = f"""
WITH {CUSTOMERS}, {ANCHOR}, x AS (SELECT c.*, {haversine_sql('anchor', 'c')} AS km FROM c, anchor)
SELECT c_custkey, c_mktsegment, round(km, 4) AS dist_km FROM x WHERE km <= 2500 AND c_acctbal >= 0 AND c_mktsegment IS NOT NULL
"""


def _right(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("lat", "r_lat").withColumnRenamed("lon", "r_lon")


def knn_by_category(spark: SparkSession, d: str) -> DataFrame:
    out = search.nearest_by_category(suppliers(spark, d).select("s_suppkey", "lat", "lon"), _right(customers(spark, d).select("c_mktsegment", "lat", "lon")), 1500.0, "s_suppkey", "c_mktsegment")
    return out.select("s_suppkey", "c_mktsegment", F.round("dist_km", 4).alias("dist_km"))


KNN_BY_CATEGORY = f"""
WITH {CUSTOMERS}, {SUPPLIERS}, x AS (SELECT s_suppkey, c_mktsegment, {haversine_sql('s', 'c')} AS km FROM s, c)
SELECT s_suppkey, c_mktsegment, round(min(km), 4) AS dist_km FROM x WHERE km <= 1500 GROUP BY ALL
"""


def dense_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest customers of each supplier, where half of all customers live in one city."""
    key = F.col("c_custkey")
    lat = F.when(key % 2 == 0, 40 + (key * 37 % 1000) / 50000.0).otherwise(F.col("lat"))
    lon = F.when(key % 2 == 0, (key * 91 % 1000) / 50000.0 - 3).otherwise(F.col("lon"))
    right = customers(spark, d).select("c_custkey", lat.alias("r_lat"), lon.alias("r_lon"))
    out = dense_places.nearest_dense(suppliers(spark, d).select("s_suppkey", "lat", "lon"), right, 1500.0, "s_suppkey", "c_custkey", 3)
    return out.select("s_suppkey", "c_custkey", F.round("dist_km", 4).alias("dist_km"), "rank")


DENSE_NEAREST = f"""
WITH {SUPPLIERS}, c0 AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer),
c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 40 + CAST(c_custkey * 37 % 1000 AS DOUBLE) / 50000 ELSE lat END AS lat, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey * 91 % 1000 AS DOUBLE) / 50000 - 3 ELSE lon END AS lon FROM c0),
x AS (SELECT s_suppkey, c_custkey, {haversine_sql('s', 'c')} AS km FROM s, c), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY km, c_custkey) AS rank FROM x WHERE km <= 1500)
SELECT s_suppkey, c_custkey, round(km, 4) AS dist_km, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
"""


def nearest_neighbor(spark: SparkSession, d: str) -> DataFrame:
    out = search.nearest_other(suppliers(spark, d).select("s_suppkey", "lat", "lon"), 2000.0, "s_suppkey", "other")
    return out.select("s_suppkey", "other", F.round("dist_km", 4).alias("dist_km"))


NEAREST_NEIGHBOR = f"""
WITH {SUPPLIERS}, x AS (SELECT a.s_suppkey, b.s_suppkey AS other, {haversine_sql('a', 'b')} AS km FROM s a JOIN s b ON a.s_suppkey <> b.s_suppkey),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY km, other) AS rn FROM x WHERE km <= 2000)
SELECT s_suppkey, other, round(km, 4) AS dist_km FROM r WHERE rn = 1
"""


def neighbor_warning(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d).select("c_custkey", "c_acctbal", "lat", "lon")
    warned = _right(c.where("c_acctbal < 0").select(F.col("c_custkey").alias("from_key"), "lat", "lon"))
    return search.counted_within(c.select("c_custkey", "lat", "lon"), warned, 400.0, "c_custkey", "from_key").withColumnsRenamed({"n": "n_warnings", "first": "first_from"})


NEIGHBOR_WARNING = f"""
WITH {CUSTOMERS}, x AS (SELECT a.c_custkey, b.c_custkey AS from_key, {haversine_sql('a', 'b')} AS km FROM c a JOIN c b ON a.c_custkey <> b.c_custkey AND b.c_acctbal < 0)
SELECT c_custkey, count(*) AS n_warnings, min(from_key) AS first_from FROM x WHERE km <= 400 GROUP BY c_custkey
"""


def active_grid(spark: SparkSession, d: str) -> DataFrame:
    return geo.active_grid(customers(spark, d), 5.0, 1)


ACTIVE_GRID = f"""
WITH {CUSTOMERS}, g AS (SELECT DISTINCT CAST(floor(lat / 5) AS BIGINT) AS a, CAST(floor(lon / 5) AS BIGINT) AS o FROM c),
x AS (SELECT least(17, greatest(-18, a + da)) AS lat_i, o + dlon + 36 AS w FROM g, range(-1, 2) t(da), range(-1, 2) u(dlon))
SELECT DISTINCT CAST(lat_i AS BIGINT) AS lat_i, CAST(((w % 72) + 72) % 72 - 36 AS BIGINT) AS lon_i FROM x
"""


def spot_key(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.floor(F.col("lat") * 100000).cast("string"), F.lit(","), F.floor(F.col("lon") * 100000).cast("string"))
    return customers(spark, d).select("c_custkey", F.substring(F.base64(F.unhex(F.sha2(text, 256))), 1, 8).alias("spot_key"))


SPOT_KEY = f"""
WITH {CUSTOMERS}
SELECT c_custkey, left(to_base64(unhex(sha256(CAST(CAST(floor(lat * 100000) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(lon * 100000) AS BIGINT) AS VARCHAR)))), 8) AS spot_key FROM c
"""


def _probe(spark: SparkSession, d: str) -> list[float]:
    """The vector of the least id: one row."""
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()["embedding"]


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where("vec_id <> 0")
    return search.similar(rows, _probe(spark, d), 20).select("vec_id", F.round("similarity", 6).alias("similarity"))


COSINE_TOPK = """
SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)),
  (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 0)), 6) AS similarity
FROM embeddings WHERE vec_id <> 0
ORDER BY list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)),
  (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 20
"""


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = (F.col("vec_id") * 7919 % 12000) / 100.0 - 60, (F.col("vec_id") * 104729 % 36000) / 100.0 - 180
    rows = table(spark, d, "embeddings").where("vec_id <> 0 AND label % 2 = 0").withColumn("lat", lat).withColumn("lon", lon)
    near = search.radius_search(rows, 10.0, 20.0, 9000.0, None, "vec_id")
    return search.similar(near, _probe(spark, d), 10).select("vec_id", F.round("similarity", 6).alias("similarity"), F.round("dist_km", 4).alias("dist_km"))


HYBRID_SEARCH = f"""
WITH e AS (SELECT *, {place_sql('vec_id')}, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)),
  (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 0)) AS sim FROM embeddings WHERE vec_id <> 0 AND label % 2 = 0), {ANCHOR},
x AS (SELECT e.*, {haversine_sql('anchor', 'e')} AS km FROM e, anchor)
SELECT vec_id, round(sim, 6) AS similarity, round(km, 4) AS dist_km FROM x WHERE km <= 9000 ORDER BY sim DESC, vec_id LIMIT 10
"""


def vehicle_compat(spark: SparkSession, d: str) -> DataFrame:
    limit = lambda c: F.when(F.col("p_size") % 5 != 0, c)
    spots = table(spark, d, "part").select(
        F.col("p_partkey").alias("spot_id"), limit(F.col("p_size") / 5.0).alias("max_length_m"), limit(F.col("p_size") / 12.0).alias("max_height_m"),
        F.lit(None).cast("double").alias("max_width_m"), F.lit(None).cast("double").alias("max_weight_t"),
        F.when(F.col("p_size") % 7 == 0, True).alias("requires_4wd"), (F.col("p_size") == 9).alias("steep_access"), F.when(F.col("p_size") == 11, "dirt").alias("surface"))
    return vehicles.compatibility(spots).select("spot_id", "vehicle", "strict", "conservative")


VEHICLE_COMPAT = """
WITH s AS (SELECT p_partkey AS spot_id, p_size, CASE WHEN p_size % 5 <> 0 THEN p_size / CAST(5 AS DOUBLE) END AS ml, CASE WHEN p_size % 5 <> 0 THEN p_size / CAST(12 AS DOUBLE) END AS mh FROM part),
v(vehicle, l, h, w, t, four) AS (VALUES ('camper_pequena', 5.0, 2.0, 2.0, NULL, false), ('gran_volumen', 6.0, 2.7, 2.1, NULL, false), ('ac_perfilada', 7.0, 2.9, 2.3, NULL, false),
  ('ac_capuchina', 7.0, 3.2, 2.3, NULL, false), ('ac_grande', 8.5, 3.4, 2.5, 4.5, false), ('4x4_camper', 5.5, 2.8, 2.1, NULL, true)),
x AS (SELECT spot_id, vehicle, l <= 5.5 AND h <= 2.2 AS small, [
  CASE WHEN ml IS NULL THEN CASE WHEN l <= 5.5 THEN 'apto' ELSE 'desconocido' END WHEN CAST(l AS DOUBLE) > ml THEN 'no_apto' ELSE 'apto' END,
  CASE WHEN mh IS NULL THEN CASE WHEN h <= 2.2 THEN 'apto' ELSE 'desconocido' END WHEN CAST(h AS DOUBLE) > mh THEN 'no_apto' ELSE 'apto' END,
  CASE WHEN w <= 2.2 THEN 'apto' ELSE 'desconocido' END,
  CASE WHEN p_size % 7 = 0 AND NOT four THEN 'no_apto' WHEN p_size % 7 <> 0 AND p_size = 11 AND NOT four AND NOT (l <= 5.5 AND h <= 2.2) THEN 'desconocido' ELSE 'apto' END,
  CASE WHEN p_size = 9 AND NOT (l <= 5.5 AND h <= 2.2) THEN 'desconocido' ELSE 'apto' END] AS all_of FROM s, v),
z AS (SELECT *, CASE WHEN list_contains(all_of, 'no_apto') THEN 'no_apto' WHEN list_contains(all_of, 'desconocido') THEN 'desconocido' ELSE 'apto' END AS strict FROM x)
SELECT spot_id, vehicle, strict, CASE WHEN strict <> 'desconocido' THEN strict WHEN small THEN 'apto' ELSE 'precaucion' END AS conservative FROM z
"""

QUERIES = {
    "bbox_search": (bbox_search, BBOX_SEARCH), "radius_search": (radius_search, RADIUS_SEARCH), "knn_by_category": (knn_by_category, KNN_BY_CATEGORY),
    "nearest_neighbor": (nearest_neighbor, NEAREST_NEIGHBOR), "neighbor_warning": (neighbor_warning, NEIGHBOR_WARNING), "active_grid": (active_grid, ACTIVE_GRID),
    "spot_key": (spot_key, SPOT_KEY), "cosine_topk": (cosine_topk, COSINE_TOPK), "hybrid_search": (hybrid_search, HYBRID_SEARCH), "vehicle_compat": (vehicle_compat, VEHICLE_COMPAT),
    "dense_nearest": (dense_nearest, DENSE_NEAREST),
}
