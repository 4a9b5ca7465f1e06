"""Rows of archives of places to places: one row a place, in columns that both forms share, and a report of what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The form of a line of the directory of motorhome stops, and of its quoted text.
LINE = r'^\s*(-?[0-9]+\.?[0-9]*),(-?[0-9]+\.?[0-9]*),"(.+)"\s*$'
STOP = r"^([A-Z]+)\s+([A-Z\-]+)\s+(.+?)(?:\s*\(\s*([^)]*?)\s*\))?\s*Aire\s+CCI\s+([0-9]+)\s*$"
#: Category of a stop to its type, and whether it is free where that is known.
STOP_TYPES = {
    "AC": ("area_ac", True),
    "ACF": ("camping", None),
    "ACS": ("camping", None),
    "APCC": ("area_ac", False),
    "APN": ("parking_privado", False),
    "AS": ("area_ac", None),
    "ASN": ("parking_publico", True),
    "AA": ("area_ac", None),
}
NAMELESS, LONGEST_NAME = "Sin nombre", 200


def _on_globe(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def stops(rows: DataFrame) -> DataFrame:
    """Places of lines: source_id, name, lat, lon, type, free, country, description; a line of another form, off the globe or
    at (0, 0) has none."""
    line = rows.where("form = 'line' AND error IS NULL").select("archive", F.col("record")["line"].alias("line"))
    part = lambda n: F.regexp_extract("line", LINE, n)
    placed = line.where(F.col("line").rlike(LINE)).select(
        "archive", part(2).cast("double").alias("lat"), part(1).cast("double").alias("lon"), F.trim(part(3)).alias("stop"))
    placed = placed.where(_on_globe(F.col("lat"), F.col("lon")) & ~((F.col("lat") == 0) & (F.col("lon") == 0)) & F.col("stop").rlike(STOP))
    said = lambda n: F.regexp_extract("stop", STOP, n)
    kind = lambda i: F.coalesce(*[F.when(said(1) == c, F.lit(v[i])) for c, v in STOP_TYPES.items()])
    code = F.nullif(F.trim(said(4)), F.lit(""))
    titled = F.initcap(F.trim(said(3)))
    name = F.when(code.isNotNull(), F.concat(titled, F.lit(" ("), code, F.lit(")"))).otherwise(titled)
    return placed.select(
        "archive", said(5).alias("source_id"), F.left(name, F.lit(LONGEST_NAME)).alias("name"), "lat", "lon",
        F.coalesce(kind(0), F.lit("otro")).alias("type"), kind(1).alias("free"), said(2).alias("country"), F.col("stop").alias("description"))


def marks(rows: DataFrame) -> DataFrame:
    """Places of Placemarks in the same columns; the id is the place to six decimals, the type comes from the style later."""
    record = lambda n: F.col("record")[n]
    lat, lon = record("lat").cast("double"), record("lon").cast("double")
    named = F.when(record("name") == "", NAMELESS).otherwise(F.left(record("name"), F.lit(LONGEST_NAME)))
    return rows.where("form = 'kml' AND error IS NULL").where(_on_globe(lat, lon)).select(
        "archive", F.format_string("%.6f_%.6f", lat, lon).alias("source_id"), named.alias("name"), lat.alias("lat"), lon.alias("lon"),
        record("style").alias("type"), F.lit(None).cast("boolean").alias("free"), F.lit(None).cast("string").alias("country"), record("description").alias("description"))


def archive_places(rows: DataFrame) -> DataFrame:
    """All places of both forms, of rows as the place_archive source gives them."""
    return stops(rows).unionByName(marks(rows))


def archive_report(rows: DataFrame) -> DataFrame:
    """For each archive and member: records read, places among them, the error if one ended it."""
    read = rows.groupBy("archive", "member").agg(F.count("record").alias("records"), F.max("error").alias("error"))
    of_lines = stops(rows.where("form = 'line'").withColumn("archive", F.struct("archive", "member")))
    of_marks = marks(rows.where("form = 'kml'").withColumn("archive", F.struct("archive", "member")))
    found = of_lines.unionByName(of_marks).groupBy(F.col("archive.archive"), F.col("archive.member")).agg(F.count(F.lit(1)).alias("places"))
    joined = read.join(found, ["archive", "member"], "left")  # an archive without members has no places
    return joined.select("archive", "member", "records", F.coalesce("places", F.lit(0)).alias("places"), "error")
