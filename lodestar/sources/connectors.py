"""Sources' raw JSON to canonical records, as declarations of paths.

A source is a table of where its fields are. One projection reads them all from
the JSON text; records without an id or a valid place are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.geo import valid_place

YES, NO = ("1", "true", "yes", "si", "sí"), ("0", "false", "no")


def flag(value: Column) -> Column:
    """Yes or no words and numbers to a boolean, anything else to null."""
    s = F.lower(F.trim(value))
    return F.when(s.isin(*YES), True).when(s.isin(*NO), False)


def any_flag(*values: Column) -> Column:
    """True if any is, false if any is and none is true, else null."""
    flags = [flag(v) for v in values]
    true = F.lit(False)
    for f in flags:
        true = true | F.coalesce(f, F.lit(False))
    return F.when(true, True).when(F.coalesce(*flags).isNotNull(), False)


def whole(value: Column) -> Column:
    return value.try_cast("int")


def number(value: Column) -> Column:
    return value.try_cast("double")


def words(value: Column, most: int = 200) -> Column:
    s = F.substring(F.trim(value), 1, most)
    return F.when(s != "", s)


def first_word_in(value: Column, table: dict[str, str], default: str | None) -> Column:
    """The value of the first key that the text holds."""
    s, out = F.lower(F.coalesce(value, F.lit(""))), None
    for k, v in table.items():
        out = F.when(F.contains(s, F.lit(k)), v) if out is None else out.when(F.contains(s, F.lit(k)), v)
    return out.otherwise(default)


def looked_up(value: Column, table: dict[str, str], default: str | None) -> Column:
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(pairs, F.upper(F.trim(value))), F.lit(default))


@dataclass(frozen=True)
class Source:
    """Paths of id, name and place, and a column for each further field; get(path) reads the JSON."""

    source_id: str
    name: str
    lat: str
    lon: str
    fields: dict[str, Callable[[Callable[[str], Column]], Column]] = field(default_factory=dict)


#: Places of a source's types, facilities and countries.
WOMO_TYPES = {"1": "parking", "2": "area_ac", "3": "area_ac", "4": "camping", "5": "naturaleza", "6": "parking", "7": "parking", "8": "area_ac", "9": "area_ac", "10": "parking", "11": "area_ac", "12": "wild"}
BOBIL_TYPES = {"CAMPING_SITE": "camping", "MOTORHOME_PARKING": "area_ac", "FREE_CAMPING": "wild", "DISPOSAL_STATION": "area_ac"}
BOBIL_FACILITIES = {"wc_publico": 3, "ducha": 2, "electricidad": 5, "agua_potable": 6, "vaciado_grises": 10, "vaciado_negras": 11, "wifi": 15}
CONTACT_TYPES = {"camperplace": "area_ac", "camping": "camping", "parking": "parking", "motorhome": "area_ac", "service": "area_ac", "nature": "naturaleza", "wild": "naturaleza", "picnic": "picnic"}
SOFT_SURFACES = ("unpaved", "gravel", "dirt", "grass", "ground", "mud", "sand", "earth", "compacted", "fine_gravel", "wood")
HARD_SURFACES = ("asphalt", "paved", "concrete", "sett", "cobblestone", "metal")
PARK4NIGHT_FLAGS = {
    "piscina": ("piscine",), "lavanderia": ("lavage", "laverie"), "gas_recharge": ("gaz", "gpl"), "juegos_ninos": ("jeux_enfants",), "mirador": ("point_de_vue",),
    "zona_protegida": ("nature_protect",), "online_booking": ("online_booking",), "winter_friendly": ("caravaneige",), "apto_motos": ("moto",), "mtb_friendly": ("vtt",),
    "surf_friendly": ("windsurf", "eaux_vives"), "fishing": ("peche", "peche_pied"), "climbing": ("escalade",), "hiking_nearby": ("rando",),
}
WOMO_FLAGS = {"agua_potable": "b_water", "electricidad": "b_electricity", "vaciado_negras": "b_chemical_wc", "wc_publico": "b_wc", "ducha": "b_shower", "wifi": "b_wifi",
              "perros": "b_animals_allowed", "acceso_grandes": "b_long_campers", "vaciado_grises": "b_disposal", "reserva_req": "b_reservation"}

#: Labels of an agricamper place's services, types of camperstop and searchforsites places, ids of alpacacamping amenities.
AGRI_SERVICES = {
    "agua_potable": ("Water",), "electricidad": ("Electrical connection",), "ducha": ("Showers",), "wifi": ("Wi-Fi",), "wc_publico": ("WC",), "vaciado_negras": ("WC drain",),
    "vaciado_grises": ("Water drain",), "perros": ("Dogs accepted (kept on a leash)", "Dogs accepted"), "iluminacion": ("Illuminated",),
}
CAMPERSTOP_TYPES = {
    **dict.fromkeys(("1", "3", "4", "6", "7", "8", "9", "12", "13", "15"), "area_ac"), **dict.fromkeys(("5", "14"), "camping"), "2": "wild", **dict.fromkeys(("10", "11"), "parking"),
}
CAMPERSTOP_FLAGS = {
    "agua_potable": "waterAvailable", "vaciado_grises": "drainageAvailable", "vaciado_negras": "chemicalAvailable", "electricidad": "powerAvailable", "wc_publico": "toiletAvailable", "ducha": "showerAvailable", "wifi": "wifiAvailable",
}
SITES_TYPES = {
    **dict.fromkeys(("AC", "ACS", "CC", "CCC", "CP"), "camping"), **dict.fromkeys(("ASN", "CL", "CS", "ACF", "CPA", "CCP", "BS", "FP", "PEC", "AS", "AA", "FC"), "area_ac"),
    **dict.fromkeys(("APN", "PS", "AP"), "parking"), **dict.fromkeys(("APCC", "WILD"), "naturaleza"),
}
PROMOBIL_TYPES = {"STELLPLATZ": "area_ac", "CAMPINGPLATZ": "camping", "PRIVATER PLATZ": "naturaleza"}
CAMPY_TYPES = {**dict.fromkeys(("CAMP", "CAMPING", "MICROCAMPING"), "camping"), "VAN": "area_ac", "PARKING": "parking_publico"}
ALPACA_IDS = {"agua_potable": (14, 238), "electricidad": (13, 223), "vaciado_grises": (20,), "vaciado_negras": (21,), "wc_publico": (16, 284), "ducha": (17, 476), "wifi": (1,)}
NOMADY_FLAGS = {"agua_potable": ("drinkingWater",), "electricidad": ("power",), "ducha": ("regularShower", "outdoorShower"), "wc_publico": ("regularToilet", "outdoorToilet", "toiletQuickAccessible")}


def truthy(value: Column) -> Column:
    """Whether a JSON value is there and neither false, 0 nor empty."""
    return F.coalesce(~F.lower(F.trim(value)).isin("false", "0", "0.0", "", "null", "[]", "{}"), F.lit(False))


def _labelled(path: str, labels: tuple[str, ...]):
    return lambda get: F.coalesce(F.arrays_overlap(F.from_json(get(path), "array<string>"), F.array(*map(F.lit, labels))), F.lit(False))


def _numbered(path: str, ids: tuple[int, ...]):
    return lambda get: F.coalesce(F.arrays_overlap(F.from_json(get(path), "array<int>"), F.array(*map(F.lit, ids))), F.lit(False))


def _any_truthy(paths: tuple[str, ...]):
    def found(get):
        out = F.lit(False)
        for p in paths:
            out = out | truthy(get(p))
        return out

    return found


def _nomady_type(get) -> Column:
    has = lambda *labels: _labelled("types", labels)(get)
    return F.when(has("hut"), "camping").when(has("caravan", "medium_vehicle", "large_vehicle"), "area_ac").when(has("tent"), "naturaleza").otherwise("otro")


def _alpaca_type(get) -> Column:
    has = lambda *ids: _numbered("amenities_infos.id", ids)(get)
    return F.when(has(27) & ~has(25, 28), "naturaleza").otherwise("area_ac")


def _flags(table: dict[str, str]) -> dict:
    return {k: (lambda get, p=p: flag(get(p))) for k, p in table.items()}


def _facility(code: int):
    return lambda get: F.coalesce(F.array_contains(F.from_json(get("facilityIds"), "array<int>"), code), F.lit(False))


SOURCES = {
    "agricamper": Source("id", "title", "adresse_latitude", "adresse_longitude", {
        "tipo": lambda get: F.when(_labelled("fiche_typologie_label", ("Agricamping",))(get), "camping").otherwise("parking_privado"), "gratuito": lambda get: F.lit(False),
        **{k: _labelled("fiche_service_label", v) for k, v in AGRI_SERVICES.items()}, "num_plazas": lambda get: whole(get("nombre_place")),
        "acceso_grandes": lambda get: F.when(get("accepte_gros_camping_car") == "1", True)}),
    "alpacacamping": Source("id", "name", "property_address.latitude", "property_address.longitude", {
        "tipo": _alpaca_type, "gratuito": lambda get: F.lit(False), "precio_aprox": lambda get: number(get("property_price.price")),
        "rating": lambda get: F.when(number(get("avg_rating")) > 0, number(get("avg_rating"))), "country_iso": lambda get: F.lower(words(get("property_address.country"))),
        **{k: _numbered("amenities_infos.id", v) for k, v in ALPACA_IDS.items()}}),
    "camperstop": Source("id", "name", "latitude", "longitude", {
        "tipo": lambda get: looked_up(get("camperStopTypeId"), CAMPERSTOP_TYPES, "otro"), "country_iso": lambda get: F.substring(get("countryCode"), 1, 2),
        **{k: (lambda get, p=p: truthy(get(p))) for k, p in CAMPERSTOP_FLAGS.items()}}),
    "campy": Source("uid", "name", "latitude", "longitude", {
        "tipo": lambda get: looked_up(get("type"), CAMPY_TYPES, "naturaleza"), "precio_aprox": lambda get: number(get("price")), "gratuito": lambda get: number(get("price")) == 0,
        "rating": lambda get: number(get("rating"))}),
    "nomady": Source("id", "title", "latitude", "longitude", {
        "tipo": _nomady_type, "gratuito": lambda get: F.lit(False), "country_iso": lambda get: F.substring(get("country"), 1, 2), **{k: _any_truthy(v) for k, v in NOMADY_FLAGS.items()}}),
    "promobil": Source("id", "_de.name", "gps[0]", "gps[1]", {"tipo": lambda get: looked_up(get("pitchType"), PROMOBIL_TYPES, "otro")}),
    "searchforsites": Source("ID", "Name", "latlng.lat", "latlng.lng", {
        "tipo": lambda get: looked_up(get("Type"), SITES_TYPES, None), "country_iso": lambda get: F.upper(F.substring(get("cID"), 1, 2))}),
    "womostell": Source("place_id", "name", "latitude", "longitude", {
        "tipo": lambda get: looked_up(get("place_type_id"), WOMO_TYPES, "area_ac"), **_flags(WOMO_FLAGS),
        "precio_aprox": lambda get: number(get("price")), "gratuito": lambda get: number(get("price")) == 0,
        "num_plazas": lambda get: whole(get("capacity")), "rating": lambda get: F.when(number(get("rm")) > 0, number(get("rm")))}),
    "bobilguiden": Source("id", "name", "location.coordinates.latitude", "location.coordinates.longitude", {
        "tipo": lambda get: looked_up(get("type"), BOBIL_TYPES, "naturaleza"), "num_plazas": lambda get: whole(get("vehicleCount")),
        **{k: _facility(v) for k, v in BOBIL_FACILITIES.items()}}),
    "campercontact": Source("id", "title", "location.lat", "location.lon", {
        "tipo": lambda get: first_word_in(F.coalesce(get("filters.poiType"), get("type")), CONTACT_TYPES, "otro"),
        "gratuito": lambda get: F.when(number(get("priceRange.min")) >= 0, number(get("priceRange.min")) == 0),
        "rating": lambda get: number(get("filters.rating")), "num_plazas": lambda get: whole(get("filters.maxCamperSpots")),
        "region": lambda get: words(F.split_part(get("subtitle"), F.lit(","), F.lit(1)))}),
    "osm": Source("id", "tags.name", "lat", "lon", {
        "acepta_caravanas": lambda get: F.when(F.lower(get("tags.caravans")).isin("yes", "permissive", "1"), True).when(F.lower(get("tags.caravans")).isin("no", "0", "private"), False),
        "acceso_dificil": lambda get: F.when(F.lower(get("tags.surface")).isin(*SOFT_SURFACES), True).when(F.lower(get("tags.surface")).isin(*HARD_SURFACES), False),
        "stars": lambda get: F.when(whole(get("tags.stars")).between(1, 5), whole(get("tags.stars")))}),
    "park4night": Source("id", "titre", "latitude", "longitude", {
        k: (lambda get, ps=ps: any_flag(*[get(p) for p in ps])) for k, ps in PARK4NIGHT_FLAGS.items()}),
}


def normalize(raw: DataFrame, source: str, column: str = "raw") -> DataFrame:
    """Canonical records of one source: source, source_id, nombre, lat, lon and its fields."""
    spec = SOURCES[source]
    get = lambda path: F.get_json_object(F.col(column), "$." + path)
    rows = raw.select(
        F.lit(source).alias("source"), get(spec.source_id).alias("source_id"), F.coalesce(words(get(spec.name)), F.lit("Sin nombre")).alias("nombre"),
        number(get(spec.lat)).alias("lat"), number(get(spec.lon)).alias("lon"), *[f(get).alias(k) for k, f in spec.fields.items()])
    return rows.where(F.col("source_id").isNotNull() & valid_place(F.col("lat"), F.col("lon")))


def _members(raw: Column) -> Column:
    """Entries of a JSON object, the last of each key; none of what is null or no object."""
    entries = F.coalesce(F.map_entries(F.from_json(raw, "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))


def checksum(raw: Column) -> Column:
    """MD5 of a JSON object's text with its top-level keys in order; null for a null text."""
    ordered = F.map_from_entries(F.array_sort(_members(raw)))
    return F.when(raw.isNotNull(), F.md5(F.to_json(ordered, {"ignoreNullFields": "false"})))


def merge_json(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects; the new one's values win, null ones too.

    Members that only the old object has come first. What is null or no object has
    no members; of members that one object repeats the last counts.
    """
    before, after = _members(old), _members(new)
    keys = F.transform(after, lambda e: e["key"])
    rest = F.filter(before, lambda e: ~F.array_contains(keys, e["key"]))
    return F.to_json(F.map_from_entries(F.concat(rest, after)), {"ignoreNullFields": "false"})
