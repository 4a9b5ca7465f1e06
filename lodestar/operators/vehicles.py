"""Whether a vehicle can use a place: limits against sizes, with unknowns kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FITS, UNFIT, UNKNOWN, CAUTION = "apto", "no_apto", "desconocido", "precaucion"
#: Sizes up to which an unknown limit is taken to fit, and rough surfaces.
SAFE = {"length_m": 5.5, "height_m": 2.2, "width_m": 2.2, "weight_t": 99.0}
ROUGH = ("dirt", "sand", "grass")
#: The preset vehicles: length, height, width, weight, four-wheel drive.
PRESETS = {
    "camper_pequena": (5.0, 2.0, 2.0, None, False),
    "gran_volumen": (6.0, 2.7, 2.1, None, False),
    "ac_perfilada": (7.0, 2.9, 2.3, None, False),
    "ac_capuchina": (7.0, 3.2, 2.3, None, False),
    "ac_grande": (8.5, 3.4, 2.5, 4.5, False),
    "4x4_camper": (5.5, 2.8, 2.1, None, True),
}


def _dimension(name: str) -> Column:
    value, limit = F.col(f"v.{name}"), F.col(f"max_{name}")
    unknown = F.when(value <= SAFE[name], FITS).otherwise(UNKNOWN)
    return F.when(value.isNull(), FITS).when(limit.isNull(), unknown).when(value > limit, UNFIT).otherwise(FITS)


def presets() -> Column:
    """The preset vehicles as one array of structs."""
    rows = [
        F.struct(F.lit(k).alias("vehicle"), *[F.lit(x).cast("double").alias(n) for n, x in zip(SAFE, v, strict=False)], F.lit(v[4]).alias("has_4wd"))
        for k, v in PRESETS.items()
    ]
    return F.array(*rows)


def compatibility(spots: DataFrame) -> DataFrame:
    """One row for each spot and preset vehicle: strict verdict, and the conservative one for unknowns."""
    rows = spots.withColumn("v", F.explode(presets()))
    small = (F.col("v.length_m") <= SAFE["length_m"]) & (F.col("v.height_m") <= SAFE["height_m"])
    drive = F.when(F.col("requires_4wd") & ~F.col("v.has_4wd"), UNFIT).when(
        F.col("requires_4wd").isNull() & F.col("surface").isin(*ROUGH) & ~F.col("v.has_4wd") & ~small, UNKNOWN).otherwise(FITS)
    steep = F.when(F.coalesce("steep_access", F.lit(False)) & ~small, UNKNOWN).otherwise(FITS)
    states = F.array(*[_dimension(n) for n in SAFE], drive, steep)
    strict = F.when(F.array_contains(states, UNFIT), UNFIT).when(F.array_contains(states, UNKNOWN), UNKNOWN).otherwise(FITS)
    rows = rows.withColumn("strict", strict)
    conservative = F.when(F.col("strict") != UNKNOWN, F.col("strict")).when(small, FITS).otherwise(CAUTION)
    return rows.withColumn("conservative", conservative).withColumn("vehicle", F.col("v.vehicle")).drop("v")


def tightest_limits(limits: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """The least limit of each dimension over all sources, with its source and confidence.

    limits: key, dimension, value, source, confidence; ties to the first source by name.
    """
    best = limits.where(F.col("value") > 0).groupBy(key, "dimension").agg(F.min(F.struct("value", "source", "confidence")).alias("x"))
    pivoted = best.groupBy(key).pivot("dimension", dimensions).agg(F.first("x"))
    columns = [F.col(f"{d}.{a}").alias(f"{d}{s}") for d in dimensions for a, s in (("value", ""), ("source", "_source"), ("confidence", "_confidence"))]
    return pivoted.select(key, *columns)


#: Confidence of the sources, and plausible metres of a limit.
SOURCE_CONFIDENCE = {"park4night": 0.92, "campingcarpark": 0.90, "promobil": 0.84, "caramaps": 0.82, "campy": 0.82}
PLAUSIBLE = {"height_m": (1.5, 4.5), "length_m": (3.0, 15.0), "width_m": (1.7, 3.5)}
#: Source, dimension, JSON path of a number.
LIMIT_PATHS = (
    ("park4night", "height_m", "hauteur_limite"), ("caramaps", "height_m", "maxHeight"), ("caramaps", "length_m", "maxLength"), ("caramaps", "width_m", "maxWidth"), ("campy", "length_m", "camperSize"),
)
#: Source, JSON path, what it must say, and the length that it then limits to.
LIMIT_FLAGS = (("promobil", "caravan8Meters", "false", 8.0), ("campingcarpark", "prohibitions.vehicleMore9m", "true", 9.0))
_PLAIN_NUMBER = r"^[0-9]+(\.[0-9]+)?$"


def source_limits(records: DataFrame) -> DataFrame:
    """Rows (spot_id, dimension, value, source, confidence) of the limits that raw records of known sources state.

    records: spot_id, source, raw (JSON). Numbers must be plain and plausible.
    """
    at = lambda path: F.get_json_object("raw", f"$.{path}")
    limit = lambda dimension, value: F.struct(F.lit(dimension).alias("dimension"), value.cast("double").alias("value"))
    found = []
    for source, dimension, path in LIMIT_PATHS:
        value = F.when(at(path).rlike(_PLAIN_NUMBER), at(path).try_cast("double"))
        found.append(F.when((F.col("source") == source) & value.between(*PLAUSIBLE[dimension]), limit(dimension, value)))
    for source, path, says, metres in LIMIT_FLAGS:
        found.append(F.when((F.col("source") == source) & (F.lower(at(path)) == says), limit("length_m", F.lit(metres))))
    sure = F.create_map(*[F.lit(x) for p in SOURCE_CONFIDENCE.items() for x in p])
    rows = records.where("spot_id IS NOT NULL").select("spot_id", "source", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    return rows.select("spot_id", "x.dimension", F.round("x.value", 2).alias("value"), "source", F.coalesce(F.try_element_at(sure, F.col("source")), F.lit(0.7)).alias("confidence"))
