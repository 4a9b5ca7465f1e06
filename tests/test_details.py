from datetime import date, datetime

from lodestar.operators import details


def test_details_with_ties_nulls_and_a_hot_spot(spark):
    make = spark.createDataFrame
    spots = make([(1, "a", "x"), (2, "b", "y"), (None, "c", "z")], "spot_id long, name string, geo_note string")
    many = [(1, i, date(2024, 1, 1 + i % 3) if i % 4 else None) for i in range(2000)] + [(None, 1, date(2024, 1, 1)), (3, 5, None)]
    reviews = make(many, "spot_id long, review_id long, date date")
    sources = make([(1, "s2", "n"), (1, "s1", None)], "spot_id long, source string, name string")
    overrides = make([(1, "water", datetime(2024, 3, 1)), (1, "dump", datetime(2024, 3, 1)), (1, "gone", datetime(2024, 2, 1)), (1, "none", None), (1, "last", datetime(2024, 4, 1))], "spot_id long, field string, expires_at timestamp")
    provenance = make([(1, "f1", False, 0.1), (1, "f2", True, 0.9), (1, "f3", True, None), (1, "f4", None, 0.1), (1, "f5", True, 0.2)], "spot_id long, field string, conflict boolean, confidence double")
    states = make([(1, "now")], "spot_id long, summary string")
    older = make([(1, "old"), (2, "old2"), (2, "old1")], "spot_id long, summary string")
    got = {r["spot_id"]: r for r in details.spot_details(spots, sources, reviews, overrides, provenance, states, older, make([(2, 7)], "spot_id long, height int"), datetime(2024, 2, 1), 5).collect()}
    assert set(got) == {1, 2, None} and all(r["geo_note"] for r in got.values())
    one, two, none = got[1], got[2], got[None]
    plain = sorted((r for r in many if r[0] == 1), key=lambda r: (r[2] is None, -(r[2] or date.min).toordinal(), r[1]))[:5]
    assert [(1, r["review_id"], r["date"]) for r in one["reviews"]] == plain
    assert [tuple(s) for s in one["sources"]] == [("s1", None), ("s2", "n")]
    assert [o["field"] for o in one["field_overrides"]] == ["last", "dump", "water"]
    assert [p["field"] for p in one["provenance"]] == ["f5", "f2", "f3", "f1", "f4"]
    assert (one["enrichment"]["summary"], one["enrichment_source"], one["geo"]) == ("now", "state", None)
    assert (two["enrichment"]["summary"], two["enrichment_source"], two["geo"]["height"], two["reviews"], two["sources"]) == ("old1", "enrichment", 7, [], [])
    assert (none["name"], none["enrichment"], none["enrichment_source"], none["provenance"]) == ("c", None, None, [])
    assert details.spot_details(spots.limit(0), sources, reviews, overrides, provenance, states, older, make([], "spot_id long, height int"), datetime(2024, 2, 1)).count() == 0
