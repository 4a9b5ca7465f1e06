"""Nearest places where some cells are crowded: an adaptive quadtree of cells, searched by distance.

One pass counts places by cell, at every depth of the tree. A cell with more than
LEAF_ROWS places is split, down to the depth of a city block, so a task never meets a
whole city. A search goes down the tree: of the cells at hand, one that holds k places
bounds how far the k-th can be, and cells that begin beyond that bound are dropped
before they are split. Only the leaves that are left meet their places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.geo import EARTH_KM, haversine_km
from lodestar.session import checkpointed

#: Places of a leaf at most, levels that a split goes down by, and the deepest level, cells of some 150 by 300 m at the equator.
LEAF_ROWS, SPLIT, DEEPEST = 256, 2, 17
#: Parts that places of one leaf are dealt to where it can't be split further.
PARTS = 16


def _radians_km(degrees: Column) -> Column:
    return F.radians(degrees) * EARTH_KM


def _axis(degrees: Column, span: float, level: int) -> Column:
    """Cell of a coordinate along its axis at a level; the last cell takes in the upper bound."""
    return F.least(F.lit((1 << level) - 1), F.floor((degrees + span / 2) / span * (1 << level))).cast("long")


def _bounds(lat: Column, lon: Column, level: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A distance that no place of a cell is under, and one that none is over."""
    side = F.pow(F.lit(2.0), level)
    width, height = 360.0 / side, 180.0 / side
    south, west = y * height - 90.0, x * width - 180.0
    over = F.greatest(F.lit(0.0), south - lat, lat - (south + height))
    middle_lat, middle_lon = south + height / 2, west + width / 2
    turn = F.abs(F.pmod(middle_lon - lon + 180.0, F.lit(360.0)) - 180.0)
    aside = F.greatest(F.lit(0.0), turn - width / 2)
    to_meridian = F.when(aside >= 90.0, F.radians(90.0 - F.abs(lat))).otherwise(F.asin(F.sin(F.radians(aside)) * F.cos(F.radians(lat)))) * EARTH_KM
    widest = F.cos(F.radians(F.greatest(F.lit(0.0), F.abs(middle_lat) - height / 2)))
    farthest = haversine_km(lat, lon, middle_lat, middle_lon) + _radians_km(height / 2) + _radians_km(width / 2) * widest
    slack = 1e-6
    return F.greatest(_radians_km(over), to_meridian) - slack, farthest + slack


def _first_level(radius_km: float) -> int:
    """The deepest level whose cells are no lower than the radius."""
    return max(0, min(DEEPEST, int(math.floor(math.log2(math.pi * EARTH_KM / radius_km)))))


def cell_counts(places: DataFrame, first: int, deepest: int = DEEPEST, lat: str = "r_lat", lon: str = "r_lon") -> DataFrame:
    """Rows (level, x, y, n) of the cells that hold places, from level `first` on, SPLIT apart."""
    last = first + (deepest - first) // SPLIT * SPLIT
    finest = places.groupBy(_axis(F.col(lon), 360.0, last).alias("x"), _axis(F.col(lat), 180.0, last).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    up = lambda level: F.struct(F.lit(level).alias("level"), F.shiftright("x", last - level).alias("x"), F.shiftright("y", last - level).alias("y"))
    each = finest.select(F.explode(F.array(*[up(k) for k in range(first, last + 1, SPLIT)])).alias("c"), "n")
    return each.groupBy("c").agg(F.sum("n").alias("n")).select("c.*", "n")


def nearest_dense(left: DataFrame, right: DataFrame, radius_km: float, left_key: str, right_key: str, k: int = 1,
                  leaf_rows: int = LEAF_ROWS, deepest: int = DEEPEST) -> DataFrame:
    """Rows (left_key, right_key, dist_km, rank): the k nearest of `right` (r_lat, r_lon) within the radius; ties to smaller keys.

    left_key tells the rows of `left` (lat, lon) apart. Rows without a place have no neighbours.
    """
    if radius_km >= EARTH_KM * math.pi / 4:
        raise ValueError("radius_km must be under an eighth of the equator")
    places = right.where("r_lat IS NOT NULL AND r_lon IS NOT NULL").select(right_key, "r_lat", "r_lon")
    first = _first_level(radius_km)
    last = first + (deepest - first) // SPLIT * SPLIT
    cells = checkpointed(cell_counts(places, first, deepest))
    height, width, n_x = 180.0 / (1 << first), 360.0 / (1 << first), 1 << first
    reach = math.degrees(radius_km / EARTH_KM)
    lat, lon = F.col("lat"), F.col("lon")
    polar = F.abs(lat) + reach >= 90.0
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(reach))) / F.cos(F.radians(lat))))) + 1e-6
    west, east = F.floor((lon - wide + 180.0) / width), F.floor((lon + wide + 180.0) / width)
    across = F.when(polar | (east - west >= n_x), F.sequence(F.lit(0).cast("long"), F.lit(n_x - 1).cast("long"))).otherwise(F.transform(F.sequence(west, east), lambda x: F.pmod(x, F.lit(n_x))))
    rows = F.sequence(F.greatest(F.lit(0), F.floor((lat - reach + 90.0) / height)).cast("long"), F.least(F.lit(n_x - 1), F.floor((lat + reach + 90.0) / height)).cast("long"))
    near = left.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col(left_key).alias("key"), "lat", "lon", F.explode(rows).alias("y"), across.alias("across"))
    near = near.select("key", "lat", "lon", F.explode("across").alias("x"), "y").withColumn("level", F.lit(first)).join(cells, ["level", "x", "y"])
    low, high = _bounds(lat, lon, F.col("level"), F.col("x"), F.col("y"))
    of_one = Window.partitionBy("key")

    def pruned(at_hand: DataFrame) -> DataFrame:
        """Cells that may hold one of the k nearest within the radius."""
        kth = F.least(F.lit(radius_km), F.coalesce(F.min(F.when(F.col("n") >= k, F.col("high"))).over(of_one), F.lit(radius_km)))
        return at_hand.withColumns({"low": low, "high": high}).withColumn("kth", kth).where("low <= kth").drop("low", "high", "kth")

    near = pruned(near)
    for level in range(first, last, SPLIT):
        whole = F.col("n") <= leaf_rows
        below = cells.where(F.col("level") == level + SPLIT).select(
            F.shiftright("x", SPLIT).alias("up_x"), F.shiftright("y", SPLIT).alias("up_y"), F.col("level").alias("b_level"), F.col("x").alias("b_x"), F.col("y").alias("b_y"), F.col("n").alias("b_n"))
        crowded = near.where(~whole & (F.col("level") == level))
        down = crowded.join(below, (F.col("x") == F.col("up_x")) & (F.col("y") == F.col("up_y"))).select(
            "key", "lat", "lon", F.col("b_level").alias("level"), F.col("b_x").alias("x"), F.col("b_y").alias("y"), F.col("b_n").alias("n"))
        near = near.where(whole | (F.col("level") < level)).unionByName(down.select(*near.columns))
        near = checkpointed(pruned(near))
        if near.where((F.col("level") == level + SPLIT) & ~whole).isEmpty():
            break
    # a place stands in the leaf that its finest cell is part of: the first cell down the tree that isn't split
    is_leaf = (F.col("n") <= leaf_rows) | (F.col("level") == last)
    leaves = near.where(is_leaf).select("level", "x", "y").distinct()
    used = [r["level"] for r in leaves.select("level").distinct().collect()]  # a few levels
    at = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), _axis(F.col("r_lon"), 360.0, v).alias("x"), _axis(F.col("r_lat"), 180.0, v).alias("y")) for v in used or [first]])).alias("c")
    dealt = places.withColumn("part", F.pmod(F.xxhash64(right_key), F.lit(PARTS)).cast("int")).select("*", at).select(right_key, "r_lat", "r_lon", "part", "c.*")
    parts = near.where(is_leaf).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))) if last in used else near.where(is_leaf)
    pairs = parts.join(dealt, ["level", "x", "y", "part"] if last in used else ["level", "x", "y"])
    pairs = pairs.select("key", right_key, haversine_km(lat, lon, F.col("r_lat"), F.col("r_lon")).alias("dist_km")).where(F.col("dist_km") <= radius_km)
    ranked = pairs.withColumn("rank", F.row_number().over(of_one.orderBy("dist_km", right_key))).where(F.col("rank") <= k)
    return ranked.select(F.col("key").alias(left_key), right_key, "dist_km", "rank")
