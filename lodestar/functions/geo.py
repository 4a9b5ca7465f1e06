"""Places on the sphere, and joins of places within a radius.

Spark has no spatial join. Places are put into cells no smaller than the radius,
one side is copied to its neighbouring cells, and an equi-join on the cell brings
candidates together, which the exact distance then decides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Cells are this much wider than the radius, against rounding at their edges.
SLACK = 1 + 1e-9


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(EARTH_KM * 2) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def valid_place(lat: Column, lon: Column) -> Column:
    """Neither null, NaN, out of range nor the origin."""
    real = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return real & lat.between(-90, 90) & lon.between(-180, 180) & ~((F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6))


def _band_height(radius_km: float) -> float:
    return math.degrees(radius_km / EARTH_KM) * SLACK


def _cells_of_band(band: Column, radius_km: float) -> Column:
    """How many equal cells a latitude band has: as many as keep each at least a radius wide."""
    height, delta = _band_height(radius_km), radius_km / EARTH_KM
    top = F.least(F.lit(90.0), F.greatest(F.abs(band * height), F.abs((band + 1) * height)))
    cos_top = F.cos(F.radians(top))
    width = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(delta, math.pi / 2))) / cos_top))) * SLACK
    many = F.greatest(F.lit(1), F.floor(360 / width)).cast("long")
    return F.when((cos_top <= math.sin(min(delta, math.pi / 2))) | F.lit(delta >= math.pi / 2), F.lit(1).cast("long")).otherwise(many)


def own_cell(lat: Column, lon: Column, radius_km: float) -> Column:
    """struct<band, cell> of a place."""
    band = F.floor(lat / _band_height(radius_km)).cast("long")
    return F.struct(band.alias("band"), _cell_in(band, lon, radius_km).alias("cell"))


def _cell_in(band: Column, lon: Column, radius_km: float) -> Column:
    n = _cells_of_band(band, radius_km)
    return F.least(n - 1, F.floor(F.pmod(lon + 180, F.lit(360.0)) / (360 / n)).cast("long"))


def near_cells(lat: Column, lon: Column, radius_km: float) -> Column:
    """Distinct cells that hold every place within the radius of this one."""
    band = F.floor(lat / _band_height(radius_km)).cast("long")

    def around(b: Column) -> Column:
        n, cell = _cells_of_band(b, radius_km), _cell_in(b, lon, radius_km)
        return F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.struct(b.alias("band"), F.pmod(cell + d, n).alias("cell")))

    return F.array_distinct(F.flatten(F.transform(F.sequence(band - 1, band + 1), around)))


def radius_join(left: DataFrame, right: DataFrame, radius_km: float, lat: str = "lat", lon: str = "lon",
                r_lat: str = "r_lat", r_lon: str = "r_lon", on: Sequence[str] = ()) -> DataFrame:
    """All pairs within the radius, with dist_km, that agree in `on`. `right` is copied to its neighbouring cells."""
    if radius_km >= EARTH_KM * math.pi / 4:
        raise ValueError("radius_km must be under an eighth of the equator")
    a = left.withColumn("_cell", own_cell(F.col(lat), F.col(lon), radius_km))
    b = right.withColumn("_cell", F.explode(near_cells(F.col(r_lat), F.col(r_lon), radius_km)))
    pairs = a.join(b, ["_cell", *on]).drop("_cell")
    return pairs.withColumn("dist_km", haversine_km(F.col(lat), F.col(lon), F.col(r_lat), F.col(r_lon))).where(F.col("dist_km") <= radius_km)


def in_polygon(lat: Column, lon: Column, rings: Column) -> Column:
    """Ray casting over rings, an array of arrays of struct<lon, lat>; inside an odd number of crossings."""

    def crossings(ring: Column) -> Column:
        edges = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))
        crossed = F.filter(
            edges,
            lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat))
            & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"]),
        )
        return F.size(crossed)

    total = F.aggregate(F.transform(rings, crossings), F.lit(0), lambda n, c: n + c)
    return total % 2 == 1


def active_grid(places: DataFrame, step: float, reach: int, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Distinct grid cells (lat_i, lon_i) within `reach` cells of a place; longitude wraps, latitude stops."""
    per_turn, top = int(round(360 / step)), int(math.floor(90 / step))
    cells = places.select(F.floor(F.col(lat) / step).cast("long").alias("a"), F.floor(F.col(lon) / step).cast("long").alias("o")).distinct()
    around = F.sequence(F.lit(-reach), F.lit(reach))
    spread = cells.select("o", "a", F.explode(around).alias("da")).select("o", "a", "da", F.explode(around).alias("do"))
    half = per_turn // 2
    return spread.select(
        F.least(F.lit(top - 1), F.greatest(F.lit(-top), F.col("a") + F.col("da"))).cast("long").alias("lat_i"),
        (F.pmod(F.col("o") + F.col("do") + half, F.lit(per_turn)) - half).cast("long").alias("lon_i"),
    ).distinct()
