"""Rows at the same place met as one: what pairs of places decide is worked out once for a place, however many rows it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import geo, text
from lodestar.session import checkpointed

#: A nearest place is looked for in circles of these parts of the radius, one after the other, until there is one.
CIRCLES = (16, 4, 1)
#: Kilometres from a circle's edge within which a place doesn't settle the search, against rounding.
EDGE_KM = 1e-8


def least_keys(rows: DataFrame, by: Sequence[str], key: str, k: int = 2) -> DataFrame:
    """Rows (by, key, at): of those that agree in `by`, nulls too, the k least different keys, at from 1."""
    each = rows.select(*by, key).distinct()
    return each.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where(F.col("at") <= k)


def with_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with `similarity`, by trigrams, of two names; each pair of names is compared once."""
    names = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    known = names.withColumn("similarity", text.trigram_similarity(F.col("_a"), F.col("_b")))
    return pairs.join(known, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b")), "left").drop("_a", "_b")


def back_to_rows(rows: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with what was found for their columns `by`, nulls equal to nulls; rows without any drop out."""
    right = found.select(*[F.col(c).alias(f"_{c}") if c in by else F.col(c) for c in found.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(right, same).drop(*[f"_{c}" for c in by])


def in_circles(left: DataFrame, right: DataFrame, radius_km: float, best: Column, on: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Rows of `left` (lat, lon, on; no two alike) with `best`, the least such value over rows of `right` (r_lat, r_lon, on) within the radius.

    `best` must come in the order of the distance first. Rows of `on` are never null.
    """
    waiting, found = left, None
    for part in CIRCLES:
        circle = radius_km / part
        pairs = geo.radius_join(waiting, right, circle, on=on)
        pairs = pairs if where is None else pairs.where(where)
        got = pairs.groupBy(*left.columns).agg(F.min(best).alias("best"), F.min("dist_km").alias("_nearest"))
        got = checkpointed(got if part == CIRCLES[-1] else got.where(F.col("_nearest") <= circle - EDGE_KM)).drop("_nearest")
        found = got if found is None else found.union(got)
        waiting = waiting.join(got, left.columns, "left_anti")
    return found
