import pytest

from lodestar.functions import wording
from lodestar.operators import merging, places, vehicles
from lodestar.sources import sinks


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(list(x), "country string, n int")
    sinks.replace_partitions(rows(("es", 1), ("fr", 2)), path, "country")
    sinks.replace_partitions(rows(("fr", 3)), path, "country")
    assert {(r.country, r.n) for r in spark.read.parquet(path).collect()} == {("es", 1), ("fr", 3)}
    sinks.append(rows(("es", 9)), f"{tmp_path}/a")
    sinks.append(rows(("es", 9)), f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 2


def test_snapshots_and_reports(spark, tmp_path):
    one, two = spark.range(2), spark.range(5)
    assert sinks.refresh_snapshot(one, f"{tmp_path}/v", 1).count() == 2
    assert sinks.refresh_snapshot(two, f"{tmp_path}/v", 2).count() == 5
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.refresh_snapshot(two, f"{tmp_path}/v", 2)
    for form in ("json", "csv"):
        sinks.report(two, f"{tmp_path}/{form}", form)
        assert spark.read.option("header", True).format(form).load(f"{tmp_path}/{form}").count() == 5
    with pytest.raises(ValueError):
        sinks.report(two, f"{tmp_path}/x", "xml")


def test_limits_of_sources(spark):
    rows = [(1, "park4night", '{"hauteur_limite": "2.1"}'), (1, "park4night", '{"hauteur_limite": "0"}'), (1, "caramaps", '{"maxHeight": "1e1", "maxLength": "7.25"}'), (2, "promobil", '{"caravan8Meters": false}'),
            (2, "campingcarpark", '{"prohibitions": {"vehicleMore9m": true}}'), (3, "campy", '{"camperSize": 99}'), (None, "campy", '{"camperSize": 9}'), (4, "campy", None)]
    got = vehicles.source_limits(spark.createDataFrame(rows, "spot_id long, source string, raw string")).collect()
    assert {(r.spot_id, r.dimension, r.value, r.source) for r in got} == {
        (1, "height_m", 2.1, "park4night"), (1, "length_m", 7.25, "caramaps"), (2, "length_m", 8.0, "promobil"), (2, "length_m", 9.0, "campingcarpark")}


def test_access(spark):
    rows = [(1, {"tracktype": "grade4"}), (1, {"highway": "residential"}), (2, {"highway": "service"}), (3, {"highway": "path"}), (4, {"maxheight": "2.9 m"}), (5, {"maxheight": "3.1"}), (6, {"maxheight": "?"}), (7, None)]
    got = {r.spot_id: (r.verdict, r.detail) for r in places.access_of(spark.createDataFrame(rows, "spot_id long, tags map<string,string>")).collect()}
    assert got == {1: ("EXCLUSION", "track_grade4"), 2: ("ACCESSIBLE", ""), 3: ("UNKNOWN", ""), 4: ("EXCLUSION", "maxheight_2.9 m"), 5: ("UNKNOWN", ""), 6: ("EXCLUSION", "maxheight_?"), 7: ("UNKNOWN", "")}


def test_descriptions_show_good_and_bad(spark):
    rows = [(1, "wind_exposure", 0.9, None, None), (1, "quietness", 0.9, None, None), (2, "theft_risk", 1.0, None, None), (2, "noise", 0.7, None, None), (2, "police_risk", 0.8, None, None),
            (3, "noise_source", None, None, "road"), (3, "sea_view", None, False, None), (3, "unknown", 1.0, None, None), (4, "beauty", None, None, None)]
    got = wording.compact_description(spark.createDataFrame(rows, "entity_id long, signal string, score_num double, score_bool boolean, score_text string")).collect()
    assert {r.entity_id: r.dsl for r in got} == {1: "quiet:+0.8 shelter:-0.8", 2: "noise:-0.4 police:-0.6 theft:-1.0", 3: "sea:F noisesrc:road"}


def test_shell_merge(spark):
    spots = spark.createDataFrame([(1, ["a"], True, None), (2, ["b", "a"], True, "note")], "spot_id long, sources array<string>, active boolean, warning string")
    reviews = spark.createDataFrame([(1, "s", "x", 10), (2, "s", "x", 11), (2, "s", "y", 12)], "spot_id long, source string, source_review_id string, review_id long")
    got = merging.merge_shells(spots, reviews, spark.createDataFrame([(2, 1)], "old_id long, new_id long")).orderBy("spot_id").collect()
    assert [tuple(r) for r in got] == [(1, ["a", "b"], True, None, 2), (2, ["a", "b"], False, "note | merged into 1", 0)]
