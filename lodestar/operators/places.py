"""Places by their tags: categories of the neighbourhood, access, regions, and the grid that covers a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import geo

#: Category, tag key, tag value.
CATEGORIES = (
    ("drinking_water", "amenity", "drinking_water"),
    ("dump_station", "amenity", "sanitary_dump_station"),
    ("supermarket", "shop", "supermarket"),
    ("fuel", "amenity", "fuel"),
    ("pharmacy", "amenity", "pharmacy"),
    ("viewpoint", "tourism", "viewpoint"),
    ("bakery", "shop", "bakery"),
    ("laundry", "shop", "laundry"),
    ("restaurant", "amenity", "restaurant"),
    ("ev_charging", "amenity", "charging_station"),
    ("beach", "natural", "beach"),
)
#: Fixed values of the access classes.
ROUGH_SURFACE = ("dirt", "ground", "earth", "mud", "sand", "grass", "unpaved", "fine_gravel", "gravel", "pebblestone", "rock", "compacted")
ROUGH_TRACK = ("grade3", "grade4", "grade5")
PAVED_CLASSES = ("primary", "secondary", "tertiary", "residential", "unclassified", "living_street", "service", "trunk")
LOW_METERS, NEAREST_REGION_KM = 3.0, 50.0


def category(tags: Column) -> Column:
    """The first category that the tags have."""
    out = [F.when(F.try_element_at(tags, F.lit(key)) == value, name) for name, key, value in CATEGORIES]
    return F.coalesce(*out)


def key_category(tags: Column) -> Column:
    """The category by keys in the order in which CATEGORIES first names them, as imports of extracts take it."""
    keys = dict.fromkeys(key for _, key, _ in CATEGORIES)
    return F.coalesce(*[F.when(F.try_element_at(tags, F.lit(key)) == value, name) for k in keys for name, key, value in CATEGORIES if key == k])


def extract_places(entities: DataFrame) -> DataFrame:
    """category, osm_type, osm_id, lon, lat of the nodes and ways of a category.

    entities: kind, id, lon_e7, lat_e7, tags, refs, as the osm_pbf source gives them, ids
    unique in each kind. A way is at the mean of its nodes, each as often as the way names
    it; nodes that are missing or off the globe don't count, and a way without any has no row.
    """
    at = entities.where("kind = 'node' AND lon_e7 BETWEEN -1800000000 AND 1800000000 AND lat_e7 BETWEEN -900000000 AND 900000000")
    degrees = lambda e7: F.col(e7) / 1e7
    nodes = at.withColumn("category", key_category(F.col("tags"))).where("category IS NOT NULL")
    ways = entities.where("kind = 'way'").select("id", key_category(F.col("tags")).alias("category"), "refs").where("category IS NOT NULL")
    ends = ways.select("id", "category", F.explode("refs").alias("ref")).join(at.select(F.col("id").alias("ref"), "lon_e7", "lat_e7"), "ref")
    mean = lambda e7: F.sum(e7) / F.count(F.lit(1)) / 1e7
    means = ends.groupBy("id", "category").agg(mean("lon_e7").alias("lon"), mean("lat_e7").alias("lat"))
    return nodes.select("category", F.lit("node").alias("osm_type"), F.col("id").alias("osm_id"), degrees("lon_e7").alias("lon"), degrees("lat_e7").alias("lat")).unionByName(
        means.select("category", F.lit("way").alias("osm_type"), F.col("id").alias("osm_id"), "lon", "lat"))


def nearest_by_category(elements: DataFrame) -> DataFrame:
    """Kilometres to each spot's nearest element of each category.

    elements: spot_id, lat, lon, tags, e_lat, e_lon, center (lat, lon), one row for
    each element near a spot; an element without a place of its own has its centre's.
    """
    lat, lon = F.coalesce("e_lat", "center.lat"), F.coalesce("e_lon", "center.lon")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), lat, lon)
    rows = elements.select("spot_id", category(F.col("tags")).alias("category"), km.alias("km"))
    return rows.where("category IS NOT NULL AND km IS NOT NULL").groupBy("spot_id", "category").agg(F.min("km").alias("km"))


def access_of(elements: DataFrame) -> DataFrame:
    """Verdict on each spot's access from the ways and barriers around it: exclusion before accessible, else unknown.

    elements: spot_id, tags.
    """
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    height = F.trim(F.regexp_replace(tag("maxheight"), "m", ""))
    meters = F.when(height.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), height.try_cast("double"))
    reasons = F.array(
        F.when((tag("4wd_only") == "yes") | (tag("motor_vehicle") == "4wd_only"), "4wd_only"),
        F.when(tag("tracktype").isin(*ROUGH_TRACK), F.concat(F.lit("track_"), tag("tracktype"))),
        F.when(tag("surface").isin(*ROUGH_SURFACE), F.concat(F.lit("surface_"), tag("surface"))),
        F.when(meters < LOW_METERS, F.concat(F.lit("maxheight_"), tag("maxheight"))).when(tag("maxheight").isNotNull() & meters.isNull(), "maxheight_?"),
        F.when(tag("maxwidth").isNotNull(), F.concat(F.lit("maxwidth_"), tag("maxwidth"))),
    )
    paved = tag("highway").isin(*PAVED_CLASSES) & ~F.coalesce(tag("surface").isin(*ROUGH_SURFACE), F.lit(False))
    rows = elements.select("spot_id", F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"), F.coalesce(paved, F.lit(False)).alias("paved"))
    # distinct reasons before they are gathered, so a spot's list is short
    found = rows.select("spot_id", F.explode("reasons").alias("reason")).distinct().groupBy("spot_id").agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("detail"))
    per = rows.groupBy("spot_id").agg(F.bool_or("paved").alias("paved")).join(found, "spot_id", "left")
    verdict = F.when(F.col("detail").isNotNull(), "EXCLUSION").when(F.col("paved"), "ACCESSIBLE").otherwise("UNKNOWN")
    return per.select("spot_id", verdict.alias("verdict"), F.coalesce("detail", F.lit("")).alias("detail"))


def box_grid(boxes: DataFrame, step: float) -> DataFrame:
    """Cells (box_id, lat, lon) of `step` degrees from the south-west corner that cover each box.

    boxes: box_id, south, west, north, east. A box without extent, or with a null in it, has no cells.
    """
    cells = lambda low, high: F.ceil((F.col(high) - F.col(low)) / step).cast("int")
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1))
    rows = boxes.select("*", F.explode(steps(cells("south", "north"))).alias("_i"))
    found = rows.select("*", F.explode(steps(cells("west", "east"))).alias("_j"))
    return found.select("box_id", (F.col("south") + F.col("_i") * step).alias("lat"), (F.col("west") + F.col("_j") * step).alias("lon"))


def _edge_km(lat: Column, lon: Column, ring: Column) -> Column:
    """Kilometres to the nearest edge of a ring, on a plane that touches the globe at the point."""
    scale = geo.EARTH_KM * 3.141592653589793 / 180
    flat = F.transform(ring, lambda p: F.struct(((p["lon"] - lon) * F.cos(F.radians(lat)) * scale).alias("x"), ((p["lat"] - lat) * scale).alias("y")))

    def distance(i: Column) -> Column:
        a, b = F.get(flat, i), F.get(flat, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        square, along = dx * dx + dy * dy, -(a["x"] * dx + a["y"] * dy)
        ends = F.least(F.sqrt(F.pow(a["x"], 2) + F.pow(a["y"], 2)), F.sqrt(F.pow(b["x"], 2) + F.pow(b["y"], 2)))
        # beside the edge, by the cross product: exactly 0 on an edge along an axis, which a foot on the edge isn't
        return F.when((along > 0) & (along < square), F.abs(a["x"] * dy - a["y"] * dx) / F.sqrt(square)).otherwise(ends)

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(ring) - 2), distance))


def regions_of(points: DataFrame, regions: DataFrame, cell: float = 1.0) -> DataFrame:
    """The region that holds each point, else the nearest one within NEAREST_REGION_KM of its edge.

    points: point_id, lat, lon. regions: region_id, ring (closed, array of (lon, lat)).
    A ring meets points through the cells of its box, widened by that distance.
    """
    margin = NEAREST_REGION_KM / 111.0
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    narrow = F.greatest(F.lit(0.05), F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs(F.array_max(lats)), F.abs(F.array_min(lats))) + margin))))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    boxes = regions.withColumn("row", span(F.array_min(lats) - margin, F.array_max(lats) + margin))
    boxes = boxes.withColumn("col", span(F.array_min(lons) - margin / narrow, F.array_max(lons) + margin / narrow))
    near = points.withColumn("row", F.floor(F.col("lat") / cell)).withColumn("col", F.floor(F.col("lon") / cell)).join(boxes, ["row", "col"])
    inside = geo.in_polygon(F.col("lat"), F.col("lon"), F.array("ring"))
    km = F.when(inside, 0.0).otherwise(_edge_km(F.col("lat"), F.col("lon"), F.col("ring")))
    found = near.select("point_id", "region_id", km.alias("km")).where(F.col("km") <= NEAREST_REGION_KM)
    best = found.groupBy("point_id").agg(F.min(F.struct("km", "region_id")).alias("x"))
    return points.select("point_id").join(best, "point_id", "left").select("point_id", "x.region_id", (F.col("x.km") == 0).alias("inside"))
