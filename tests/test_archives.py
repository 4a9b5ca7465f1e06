import zipfile

import pytest

from lodestar.operators import archive_places as archived
from lodestar.sources import archives

KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:x="urn:x"><Document><Style id="a"><x:y/></Style><Folder>
<Placemark><name> Spring &amp; rest </name><description><![CDATA[ <b>wäter</b> ]]></description><styleUrl>#tap</styleUrl><Point><coordinates> 1.5,-2.25,9 </coordinates></Point></Placemark>
<Placemark><name>two places</name><MultiGeometry><Point><coordinates>3,4</coordinates></Point><Point><coordinates>5,6</coordinates></Point></MultiGeometry></Placemark>
</Folder><Placemark><name/><Point><coordinates>7,8</coordinates></Point></Placemark><Placemark><name>nowhere</name></Placemark>
<Placemark><name>no number</name><Point><coordinates>a,b</coordinates></Point></Placemark><Placemark><name>off</name><Point><coordinates>200,8</coordinates></Point></Placemark>
</Document></kml>"""
LINES = """1.5,45,"AC FRANCE SAINT-JEAN D'ANGELY  (17400 ) Aire CCI 33603"\r
\r
2,46.25,"AA SLOVENIE PETROL  Aire CCI 3439"\r
0,0,"AC FRANCE X (1) Aire CCI 1"\r
3,95,"AC FRANCE X (1) Aire CCI 2"\r
3,45,"AC FRANCE X (1)"\r
a,45,"AC FRANCE X (1) Aire CCI 4"\r
4,45,"QQ PAYS-BAS \xc9PE ()Aire CCI 5"\r
"""


def _load(spark, path):
    archives.register(spark)
    return spark.read.format("place_archive").load(str(path))


def _zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_both_forms(spark, tmp_path):
    _zip(tmp_path / "a.kmz", {"doc.kml": KML, "icon.png": b"x"})
    _zip(tmp_path / "b.zip", {"in/Atotales_CCI.asc": LINES.encode("latin-1"), "other.asc": "1,1,\"AC FRANCE Y Aire CCI 9\""})
    rows = _load(spark, tmp_path)
    got = {(r.source_id, r.name, r.lat, r.lon, r.type, r.free, r.country, r.description) for r in archived.archive_places(rows).collect()}
    assert got == {
        ("-2.250000_1.500000", "Spring & rest", -2.25, 1.5, "#tap", None, None, "<b>wäter</b>"),
        ("4.000000_3.000000", "two places", 4.0, 3.0, "", None, None, ""),
        ("8.000000_7.000000", "Sin nombre", 8.0, 7.0, "", None, None, ""),
        ("33603", "Saint-jean D'angely (17400)", 45.0, 1.5, "area_ac", True, "FRANCE", "AC FRANCE SAINT-JEAN D'ANGELY  (17400 ) Aire CCI 33603"),
        ("3439", "Petrol", 46.25, 2.0, "area_ac", None, "SLOVENIE", "AA SLOVENIE PETROL  Aire CCI 3439"),
        ("5", "Épe", 45.0, 4.0, "otro", None, "PAYS-BAS", "QQ PAYS-BAS ÉPE ()Aire CCI 5"),
    }
    report = sorted(map(tuple, archived.archive_report(rows).collect()))
    assert report == [("a.kmz", "doc.kml", 4, 3, None), ("b.zip", "in/Atotales_CCI.asc", 7, 3, None)]


def test_what_is_broken_is_reported(spark, tmp_path):
    (tmp_path / "noise.zip").write_bytes(b"noise")
    _zip(tmp_path / "none.zip", {"x.txt": "x"})
    _zip(tmp_path / "cut.kmz", {"good.kml": KML, "cut.kml": KML[: KML.index("<Placemark><name/>")]})
    _zip(tmp_path / "sum.zip", {"ATOTALES_CCI.ASC": LINES.encode("latin-1")})
    data = bytearray((tmp_path / "sum.zip").read_bytes())
    data[70] ^= 255
    (tmp_path / "sum.zip").write_bytes(data)
    rows = _load(spark, tmp_path)
    report = {(r.archive, r.member): (r.records, r.places, r.error) for r in archived.archive_report(rows).collect()}
    assert report[("cut.kmz", "good.kml")] == (4, 3, None)
    assert report[("cut.kmz", "cut.kml")][:2] == (2, 2) and "ParseError" in report[("cut.kmz", "cut.kml")][2]  # what came before stays
    assert report[("noise.zip", None)][2].startswith("not an archive") and report[("none.zip", None)][2] == "no member of places"
    assert report[("sum.zip", "ATOTALES_CCI.ASC")][2] and len(report) == 5


def test_round_trip_and_empty_folder(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert _load(spark, tmp_path / "e").count() == 0
    rows = [(i / 7 - 20, i / 11, f"n<{i}> & é", None if i % 3 else " d ", "#s") for i in range(3000)]
    frame = spark.createDataFrame(rows, "lon double, lat double, name string, description string, style string")
    frame.repartition(3).write.format("place_archive").mode("append").save(str(tmp_path / "e"))
    got = archived.marks(_load(spark, tmp_path / "e")).select("lon", "lat", "name", "description", "type").collect()
    assert sorted(map(tuple, got)) == sorted((x, y, n, (d or "").strip(), s) for x, y, n, d, s in rows if -180 <= x <= 180 and y <= 90)
    assert len(list((tmp_path / "e").glob("part-*.kmz"))) == 3


def test_a_placemark_is_forgotten_once_read():
    import io
    import tracemalloc

    big = io.BytesIO(b"<kml><Document>" + b"<Placemark><name>n</name><Point><coordinates>1,2</coordinates></Point></Placemark>" * 60_000 + b"</Document></kml>")
    tracemalloc.start()
    assert sum(p is not None for p in archives.placemarks(big)) == 60_000
    assert tracemalloc.get_traced_memory()[1] < 5 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("form", ["kml", "line"])
def test_no_rows_of_a_form(spark, form):
    rows = spark.createDataFrame([("a", "m", 0, form, None, "broken")], archives.SCHEMA)
    assert archived.archive_places(rows).count() == 0
