import json

import pytest
from pyspark.sql import functions as F

from lodestar.sources import connectors


def rows(spark, *items):
    return spark.createDataFrame([(json.dumps(i) if i is not None else None,) for i in items], "raw string")


def test_womostell(spark):
    got = connectors.normalize(rows(spark, {"place_id": 7, "name": " Hof ", "latitude": "48.1", "longitude": 9, "place_type_id": 4, "b_water": 1, "b_wc": "0", "b_wifi": None, "price": 0, "rm": 0},
                                    {"place_id": 8, "latitude": 0, "longitude": 0}, None), "womostell").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.source_id, r.nombre, r.tipo, r.agua_potable, r.wc_publico, r.wifi, r.gratuito, r.rating) == ("7", "Hof", "camping", True, False, None, True, None)


def test_bobilguiden_and_campercontact(spark):
    b = connectors.normalize(rows(spark, {"id": 1, "name": "A", "type": "free_camping", "location": {"coordinates": {"latitude": 60, "longitude": 10}}, "facilityIds": [3, 6]}), "bobilguiden").first()
    assert (b.tipo, b.wc_publico, b.ducha, b.agua_potable) == ("wild", True, False, True)
    c = connectors.normalize(rows(spark, {"id": 2, "title": "", "location": {"lat": 40, "lon": 3}, "filters": {"poiType": "Camperplace", "maxCamperSpots": 12}, "priceRange": {"min": 5}, "subtitle": "Vic, Spain"}), "campercontact").first()
    assert (c.nombre, c.tipo, c.num_plazas, c.gratuito, c.region) == ("Sin nombre", "area_ac", 12, False, "Vic")


def test_extras(spark):
    o = connectors.normalize(rows(spark, {"id": 3, "lat": 1, "lon": 2, "tags": {"surface": "Gravel", "caravans": "private", "stars": "6"}}), "osm").first()
    assert (o.acceso_dificil, o.acepta_caravanas, o.stars) == (True, False, None)
    p = connectors.normalize(rows(spark, {"id": 4, "latitude": 1, "longitude": 2, "lavage": "0", "laverie": "1", "gaz": "0", "moto": ""}), "park4night").first()
    assert (p.lavanderia, p.gas_recharge, p.apto_motos, p.climbing) == (True, False, None, None)


def test_json(spark):
    df = spark.createDataFrame([('{"b":1,"a":2}', '{"a":3,"c":"x"}')], "o string, n string")
    r = df.select(connectors.checksum(F.col("o")).alias("x"), connectors.checksum(F.lit('{"a":2,"b":1}')).alias("y"), connectors.merge_json(F.col("o"), F.col("n")).alias("m")).first()
    assert r.x == r.y and json.loads(r.m) == {"b": "1", "a": "3", "c": "x"}


@pytest.mark.parametrize(
    ("source", "raw", "want"),
    [
        ("agricamper", '{"id": 7, "title": "Farm", "adresse_latitude": "43.1", "adresse_longitude": "11.2", "fiche_typologie_label": ["Agricamping"], "fiche_service_label": ["Water", "Dogs accepted"], "nombre_place": "4", "accepte_gros_camping_car": 1}',
         {"tipo": "camping", "agua_potable": True, "perros": True, "wifi": False, "num_plazas": 4, "acceso_grandes": True, "lat": 43.1}),
        ("alpacacamping", '{"id": 1, "name": "Hof", "property_address": {"latitude": 47, "longitude": 11, "country": "AT"}, "amenities_infos": {"id": [27, 14, 1]}, "property_price": {"price": "12.5"}, "avg_rating": 0}',
         {"tipo": "naturaleza", "agua_potable": True, "wifi": True, "electricidad": False, "precio_aprox": 12.5, "rating": None, "country_iso": "at"}),
        ("camperstop", '{"id": 2, "name": "Stop", "latitude": 50.1, "longitude": 4, "camperStopTypeId": 14, "waterAvailable": 1, "powerAvailable": false, "countryCode": "BEL"}',
         {"tipo": "camping", "agua_potable": True, "electricidad": False, "wifi": False, "country_iso": "BE"}),
        ("campy", '{"uid": "u", "name": "Van", "latitude": 59, "longitude": 18, "type": "Van", "price": 0}', {"tipo": "area_ac", "gratuito": True, "source_id": "u"}),
        ("nomady", '{"id": 5, "title": "Hut", "latitude": 46, "longitude": 8, "types": ["tent", "caravan"], "outdoorToilet": true, "country": "CHE"}', {"tipo": "area_ac", "wc_publico": True, "ducha": False, "country_iso": "CH"}),
        ("promobil", '{"id": "p", "_de": {"name": "Platz"}, "gps": [48.5, 9.1], "pitchType": "Campingplatz"}', {"tipo": "camping", "lat": 48.5, "lon": 9.1, "nombre": "Platz"}),
        ("searchforsites", '{"ID": 9, "Name": "Aire", "latlng": {"lat": 45, "lng": 1}, "Type": "APN", "cID": "fr1"}', {"tipo": "parking", "country_iso": "FR"}),
    ],
)
def test_declared_sources(spark, source, raw, want):
    rows = spark.createDataFrame([(raw,), ("{}",), (None,), ("broken",)], "raw string")
    got = connectors.normalize(rows, source).collect()
    assert len(got) == 1 and {k: got[0][k] for k in want} == want


def test_merge_of_json_objects(spark):
    cases = [
        ('{"a":1,"b":2}', '{"b":null,"c":"x"}', '{"a":"1","b":null,"c":"x"}'), ('{"a":1,"a":2}', '{"b":1,"b":3}', '{"a":"2","b":"3"}'),
        (None, '{"a":true}', '{"a":"true"}'), ('{"a":1}', None, '{"a":"1"}'), ("[1]", "no object", "{}"), (None, None, "{}"),
    ]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == "EXCEPTION"
    assert [r[0] for r in rows.select(connectors.merge_json(rows["a"], rows["b"])).collect()] == [want for _, _, want in cases]
    sums = [r[0] for r in spark.createDataFrame([('{"b":1,"a":2}',), ('{"a":2,"b":1}',), (None,)], "a string").select(connectors.checksum(F.col("a"))).collect()]
    assert sums[0] == sums[1] and sums[2] is None
