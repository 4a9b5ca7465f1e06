"""Structured facts of a source record into claims, one for each signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.observations import guarded_number

#: Field, signal, value if true, value if false, confidence.
FIELDS = (
    ("agua_potable", "water_working", "true", "false", 0.90),
    ("vaciado_negras", "dump_station_working", "true", "false", 0.88),
    ("vaciado_grises", "dump_station_working", "true", None, 0.82),
    ("electricidad", "electricity_working", "true", "false", 0.88),
    ("ducha", "shower_working", "true", "false", 0.85),
    ("wifi", "cell_coverage", "0.75", None, 0.72),
    ("acceso_grandes", "large_vehicle", "0.85", "0.15", 0.85),
    ("perros", "dog_friendly", "true", "false", 0.88),
    ("iluminacion", "stealth", "0.1", None, 0.68),
    ("seguridad", "safety", "0.8", None, 0.72),
    ("hiking_nearby", "hiking_nearby", "true", None, 0.80),
    ("mtb_friendly", "cycling_nearby", "true", None, 0.80),
    ("surf_friendly", "beach_access", "true", None, 0.72),
    ("juegos_ninos", "family_friendly", "true", None, 0.82),
    ("mirador", "beauty", "0.85", None, 0.68),
    ("zona_protegida", "overnight_safe", "false", None, 0.72),
    ("piscina", "swimming_access", "true", None, 0.88),
    ("climbing", "hiking_nearby", "true", None, 0.68),
    ("reserva_req", "overnight_safe", "true", None, 0.70),
    ("acceso_dificil", "road_quality", "0.2", "0.85", 0.78),
    ("acepta_caravanas", "caravan_accepted", "true", "false", 0.85),
    ("accesibilidad_reducida", "accessible_pmr", "true", None, 0.85),
    ("winter_friendly", "overnight_safe", "true", None, 0.62),
)
#: Key of the extras, the value it must have, signal, value, confidence.
EXTRAS = (
    ("campfire", True, "campfire_allowed", "true", 0.88),
    ("campfire", False, "campfire_allowed", "false", 0.88),
    ("bbq", True, "campfire_allowed", "true", 0.72),
    ("ev_charging", True, "ev_charging", "true", 0.88),
    ("ev_charging", False, "ev_charging", "false", 0.80),
    ("cell_service", True, "cell_coverage", "0.8", 0.82),
    ("cell_service", False, "cell_coverage", "0.1", 0.82),
    ("family_friendly", True, "family_friendly", "true", 0.80),
    ("family_friendly", False, "family_friendly", "false", 0.75),
    ("dogs_on_leash_only", True, "dog_friendly", "true", 0.82),
    ("firewood_available", True, "campfire_allowed", "true", 0.68),
    ("naturism", True, "wild_camping_legal", "true", 0.62),
    ("requires_4wd", True, "road_quality", "0.15", 0.85),
    ("requires_4wd", True, "large_vehicle", "0.1", 0.80),
    ("tent_allowed", True, "wild_camping_legal", "true", 0.72),
    ("tent_friendly", True, "wild_camping_legal", "true", 0.68),
    ("verified", True, "overnight_safe", "true", 0.62),
)
#: Key of the extras, its text, signal, value, confidence.
TEXTS = (
    ("mobile_signal", "3g_4g", "cell_coverage", "0.8", 0.80),
    ("ground", "paved", "road_quality", "0.85", 0.80),
    ("ground", "concrete", "road_quality", "0.85", 0.80),
    ("ground", "asphalt", "road_quality", "0.85", 0.80),
    ("ground", "loose", "road_quality", "0.25", 0.75),
    ("ground", "dirt", "road_quality", "0.2", 0.80),
    ("ground", "gravel", "road_quality", "0.3", 0.72),
    ("ground", "grass", "road_quality", "0.5", 0.65),
    ("ground", "lawn", "road_quality", "0.5", 0.65),
    ("ground", "mud", "road_quality", "0.1", 0.78),
)
#: List of the extras, its item, signal, value, confidence.
ITEMS = (
    ("environment_labels", "beach", "beach_access", "true", 0.82),
    ("environment_labels", "sea_coast", "beach_access", "true", 0.78),
    ("environment_labels", "sea", "sea_view", "true", 0.70),
    ("environment_labels", "sea_nearby", "sea_view", "true", 0.68),
    ("environment_labels", "on_water", "river_nearby", "true", 0.65),
    ("environment_labels", "river", "river_nearby", "true", 0.82),
    ("environment_labels", "river_nearby", "river_nearby", "true", 0.82),
    ("environment_labels", "lake", "lake_nearby", "true", 0.82),
    ("environment_labels", "lake_nearby", "lake_nearby", "true", 0.82),
    ("environment_labels", "mountains", "mountain_view", "true", 0.68),
    ("environment_labels", "secluded", "stealth", "0.82", 0.78),
    ("environment_labels", "alleinlage", "stealth", "0.85", 0.80),
    ("environment_labels", "calm", "quietness", "0.8", 0.70),
    ("environment_labels", "forest", "stealth", "0.65", 0.65),
    ("environment_labels", "urban", "crowd_level", "0.7", 0.62),
    ("environment_labels", "near_road", "road_noise", "0.75", 0.70),
    ("environment_labels", "carpark", "overnight_safe", "true", 0.62),
    ("vibes", "starry_sky", "dark_sky", "true", 0.82),
    ("vibes", "pure_nature", "beauty", "0.82", 0.65),
    ("vibes", "wow_factor", "beauty", "0.9", 0.68),
    ("vibes", "romantic", "beauty", "0.8", 0.62),
    ("vibes", "secluded", "stealth", "0.82", 0.72),
)
#: Part of a prohibition, signal, value, confidence.
PROHIBITIONS = (
    ("overnight", "overnight_safe", "false", 0.92),
    ("camping", "overnight_safe", "false", 0.90),
    ("dogs", "dog_friendly", "false", 0.90),
    ("fire", "campfire_allowed", "false", 0.90),
    ("campfire", "campfire_allowed", "false", 0.92),
    ("noise", "party_noise", "0.8", 0.70),
)
#: Activities, any of which makes the claim; winter sports name an unknown signal and make none.
ACTIVITIES = (
    (("swimming", "sup", "canoeing", "boating"), "swimming_access", "true", 0.78),
    (("hiking", "trekking"), "hiking_nearby", "true", 0.78),
    (("cycling", "biking", "mtb"), "cycling_nearby", "true", 0.78),
)
SMALL_PLACES, BIG_PLACES, LONG_FEET = 5, 30, 23
TRUE, FALSE = ("true", "yes", "1", "si", "sí"), ("false", "no", "0")


#: Keys of the facts and of their extras that make claims.
KEYS = tuple(dict.fromkeys([r[0] for r in FIELDS] + ["altura_max_m", "num_plazas"]))
EXTRA_KEYS = tuple(dict.fromkeys([r[0] for r in (*EXTRAS, *TEXTS, *ITEMS)] + ["prohibitions", "activities", "max_vehicle_length_ft"]))


def _parsed(records: DataFrame) -> DataFrame:
    """Records with a struct `facts` of the values by key and, by `servicios_extras.` and key, of the extras: each text is parsed once, its extras once."""
    rows = records.select("record_id", F.json_tuple("facts", *KEYS, "servicios_extras").alias(*[f"_{i}" for i in range(len(KEYS))], "_extras"))
    rows = rows.select("*", F.json_tuple("_extras", *EXTRA_KEYS).alias(*[f"_x{i}" for i in range(len(EXTRA_KEYS))]))
    fields = [F.col(f"_{i}").alias(k) for i, k in enumerate(KEYS)] + [F.col(f"_x{i}").alias(f"servicios_extras.{k}") for i, k in enumerate(EXTRA_KEYS)]
    return rows.select("record_id", F.struct(*fields).alias("facts"))


def _field(facts: Column, path: str) -> Column:
    return facts.getField(path)


def _flag(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def _claim(when: Column, signal: str, value: Column | str, confidence: float) -> Column:
    """A claim where the condition holds, else null."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.when(when, F.struct(F.lit(signal).alias("signal"), value.alias("value"), F.lit(confidence).alias("confidence")))


def _listed(facts: Column, key: str) -> Column:
    """The lower-cased items of a list of the extras; none if it isn't a list."""
    items = F.from_json(_field(facts, f"servicios_extras.{key}"), "array<string>")
    return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.lower(x))


def _from_list(items: Column, rules: list[tuple], test) -> list[Column]:
    """For each item of a list, in its order, the claims of the rules that it passes; null stays in between."""
    return F.flatten(F.transform(items, lambda x: F.array(*[_claim(test(x, key), *rest) for key, *rest in rules])))


def candidates(facts: Column) -> Column:
    """All claims that parsed facts make, in the order of precedence; null where a rule makes none."""
    single = []
    for field, signal, yes, no, confidence in FIELDS:
        flag = _flag(_field(facts, field))
        single += [_claim(flag, signal, yes, confidence), *([_claim(~flag, signal, no, confidence)] if no else [])]
    height = guarded_number(_field(facts, "altura_max_m"))
    single.append(_claim(height > 0, "height_restriction", F.round(height, 1).cast("string"), 0.95))
    places = guarded_number(_field(facts, "num_plazas")).cast("int")
    single.append(_claim(places.between(1, SMALL_PLACES), "parking_capacity", "small", 0.85))
    single.append(_claim(places >= BIG_PLACES, "parking_capacity", "big", 0.85))
    for key, wanted, signal, value, confidence in EXTRAS:
        single.append(_claim(_flag(_field(facts, f"servicios_extras.{key}")) == F.lit(wanted), signal, value, confidence))
    for key, text, signal, value, confidence in TEXTS:
        single.append(_claim(F.lower(F.trim(_field(facts, f"servicios_extras.{key}"))) == text, signal, value, confidence))
    lists = [_from_list(_listed(facts, key), [r[1:] for r in ITEMS if r[0] == key], lambda x, item: x == item) for key in ("environment_labels", "vibes")]
    lists.append(_from_list(_listed(facts, "prohibitions"), list(PROHIBITIONS), lambda x, part: F.contains(x, F.lit(part))))
    feet = guarded_number(_field(facts, "servicios_extras.max_vehicle_length_ft"))
    late = [_claim(feet >= LONG_FEET, "large_vehicle", "0.85", 0.85), _claim((feet > 0) & (feet < LONG_FEET), "large_vehicle", "0.15", 0.88)]
    done = _listed(facts, "activities")
    late += [_claim(F.arrays_overlap(done, F.array(*map(F.lit, names))), *rest) for names, *rest in ACTIVITIES]
    return F.concat(F.array(*single), *lists, F.array(*late))


def claims_of_facts(records: DataFrame) -> DataFrame:
    """Rows (record_id, signal, value, confidence): of each signal the first claim of the record.

    records: record_id, facts, a JSON object. Null and broken facts make no claims.
    """
    # the work on a record is great beside its size, so tasks get few records each, however small the input's files are
    spread = records.repartition(4 * records.sparkSession.sparkContext.defaultParallelism, "record_id")
    made = _parsed(spread).select("record_id", F.filter(candidates(F.col("facts")), lambda c: c.isNotNull()).alias("made"))
    first = F.filter("made", lambda c, i: F.array_position(F.transform("made", lambda m: m["signal"]), c["signal"]) == i + 1)
    return made.select("record_id", F.explode(first).alias("claim")).select("record_id", "claim.signal", "claim.value", "claim.confidence")
