import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.functions import decay, geo, text
from lodestar.operators import alerts, claims, llm_payload, metrics, reconcile, state, vehicles
from lodestar.streaming import incremental

AS_OF = datetime(2026, 5, 29, 12)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("t", "f", "want"), [(3, 0, 1.0), (2, 2, 0.0), (0, 0, 0.0), (1, 0, 1 / 3)])
def test_boolean_confidence(spark, t, f, want):
    assert one(spark, decay.boolean_confidence(F.lit(float(t)), F.lit(float(f)))) == pytest.approx(want)


def test_decay_boost_and_consensus(spark):
    assert one(spark, decay.half_life_decay(F.lit(1.0), F.lit(90.0), F.lit(90))) == pytest.approx(0.5)
    assert one(spark, decay.recency_boost(F.lit(0.0))) == 1.5
    assert one(spark, decay.recency_boost(F.lit(60.0))) == pytest.approx(1 + 0.5 / math.e)
    values = [one(spark, decay.consensus(F.lit(float(w)))) for w in (0, 1, 3, 6, 12, 30, 100)]
    assert values[0] == 0 and values == sorted(values) and max(values) <= 1


def test_lifecycle(spark):
    for c, r, want in ((0.8, False, "active"), (0.5, False, "active"), (0.49, False, "decaying"), (0.2, True, "likely_resolved"), (0.9, True, "likely_resolved")):
        assert one(spark, decay.lifecycle_state(F.lit(c), F.lit(r))) == want


def _vote(spark, votes):
    values = spark.createDataFrame([(1, "f", s, v, None, i) for i, (s, v, _) in enumerate(votes)], "entity_id long, field string, source string, value string, source_rank int, record_id long")
    cred = spark.createDataFrame([(s, b) for s, _, b in votes if b is not None], "source string, base_score double")
    return reconcile.weighted_vote(values, cred).first()


def test_votes(spark):
    assert _vote(spark, [("a", "T", 0.8), ("b", "T", 0.8), ("c", "T", 0.8), ("d", "F", 0.9)]).value == "T"
    assert _vote(spark, [("a", "T", 0.6), ("b", "T", 0.6), ("c", "F", 0.95)]).decision == "set"
    kept = _vote(spark, [("a", "T", 0.85), ("b", "F", 0.86)])
    assert kept.decision == "keep_existing" and kept.value is None
    assert _vote(spark, [("a", "T", 0.95), ("b", "F", None)]).value == "T"


def _observations(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, signal string, value_num double, value_bool boolean, value_text string, weight double, observed_at timestamp, date_estimated boolean, ord long")


def test_text_mode_and_closure(spark):
    signals = spark.createDataFrame([("noise_source", "text", 90), ("spot_closed", "boolean", 90), ("quiet", "numeric", 90)], "signal string, value_type string, half_life int")
    rows = [(1, "noise_source", None, None, v, w, AS_OF, False, i) for i, (v, w) in enumerate([("road", 1.0), ("road", 1.0), ("train", 0.5)])]
    rows.append((1, "spot_closed", None, True, None, 1.0, AS_OF - timedelta(days=40), False, 9))
    rows.append((2, "quiet", None, None, None, 1.0, AS_OF, None, 10))
    got = state.aggregate_observations(_observations(spark, rows), signals, AS_OF).collect()
    assert [(r.entity_id, r.signal, r.score_text) for r in got] == [(1, "noise_source", "road")]


def test_regime_change(spark):
    rows = [(1, "q", v, 1.0, AS_OF - timedelta(days=d)) for v, d in [(0.2, 400), (0.25, 380), (0.15, 360), (0.85, 60), (0.9, 40), (0.8, 20)]]
    rows += [(2, "q", v, 1.0, AS_OF - timedelta(days=d)) for v, d in [(0.2, 200), (0.25, 195), (0.15, 190), (0.85, 175), (0.9, 170), (0.8, 165)]]
    df = spark.createDataFrame(rows, "entity_id long, signal string, value double, weight double, observed_at timestamp")
    found = state.regime_change(df, AS_OF).collect()
    assert [(r.entity_id, r.n_old, r.n_new) for r in found] == [(1, 3, 3)] and found[0].since == AS_OF - timedelta(days=60)


def test_keys(spark):
    phones = {"+34 911 23 45 67": "+34911234567", "0034 911234567": "+34911234567", "911 234 567": "911234567", "(033) 1-23-45-67": "0331234567", "12345": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in phones], "p string").select("p", text.normalize_phone(F.col("p")).alias("k"))
    assert {r.p: r.k for r in df.collect()} == phones
    urls = {"https://www.campingx.com/contacto?ref=1": "campingx.com", "http://reservas.campingx.es/": "reservas.campingx.es", "https://park4night.com/x": None, "https://facebook.com/y": None, "notaurl": None}
    df = spark.createDataFrame([(k,) for k in urls], "u string").select("u", text.extract_domain(F.col("u")).alias("k"))
    assert {r.u: r.k for r in df.collect()} == urls


def test_trigrams_and_kebab(spark):
    assert one(spark, text.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert one(spark, text.kebab(F.lit(" Lake_View / Top!! "))) == "lake-view-top"


@pytest.mark.parametrize("radius", [0.1, 5.0, 50.0, 500.0, 3000.0])
@pytest.mark.parametrize("area", ["uniform", "pole", "antimeridian"])
def test_radius_join_is_brute_force(spark, radius, area):
    import random

    rng = random.Random(f"{radius}{area}")
    lat = {"uniform": lambda: rng.uniform(-90, 90), "pole": lambda: rng.uniform(88, 90), "antimeridian": lambda: rng.uniform(-3, 3)}[area]
    lon = {"uniform": lambda: rng.uniform(-180, 180), "pole": lambda: rng.uniform(-180, 180), "antimeridian": lambda: (180 + rng.uniform(-3, 3) + 180) % 360 - 180}[area]
    spots = [(i, lat(), lon()) for i in range(120)]
    left = spark.createDataFrame(spots, "a long, lat double, lon double")
    right = spark.createDataFrame(spots, "b long, r_lat double, r_lon double")
    got = {(r.a, r.b) for r in geo.radius_join(left, right, radius).select("a", "b").collect()}

    def km(p, q):
        x1, y1, x2, y2 = map(math.radians, (p[1], p[2], q[1], q[2]))
        h = math.sin((x2 - x1) / 2) ** 2 + math.cos(x1) * math.cos(x2) * math.sin((y2 - y1) / 2) ** 2
        return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(max(0, 1 - h)))

    want = {(p[0], q[0]) for p in spots for q in spots if km(p, q) <= radius}
    assert got == want


def test_polygon(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]])
    assert one(spark, geo.in_polygon(F.lit(2.0), F.lit(2.0), F.array(ring))) is True
    assert one(spark, geo.in_polygon(F.lit(5.0), F.lit(2.0), F.array(ring))) is False


def test_vehicles(spark):
    spots = spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, None, 2.0, None, None, None, None, None), (3, 10.0, 4.0, 3.0, 20.0, None, None, None), (4, None, None, None, None, True, None, None)],
                                  "spot_id long, max_length_m double, max_height_m double, max_width_m double, max_weight_t double, requires_4wd boolean, steep_access boolean, surface string")
    got = {(r.spot_id, r.vehicle): (r.strict, r.conservative) for r in vehicles.compatibility(spots).collect()}
    assert got[1, "camper_pequena"] == ("apto", "apto")
    assert got[1, "ac_grande"] == ("desconocido", "precaucion")
    assert got[2, "ac_grande"][0] == "no_apto" and got[2, "camper_pequena"][0] == "apto"
    assert got[3, "ac_grande"][0] == "apto"
    assert got[4, "ac_grande"][0] == "no_apto" and got[4, "4x4_camper"][0] != "no_apto"


def test_claims_negation(spark):
    rules = [claims.Rule("quietness", "true", 0.9, ("quiet",)), claims.Rule("overnight_allowed", "false", 0.9, ("no overnight",)), claims.Rule("overnight_allowed", "true", 0.8, ("overnight",))]
    rows = spark.createDataFrame([(1, "Very quiet place."), (2, "Not quiet at all"), (3, "No noise. quiet"), (4, "disquieting"), (5, "no overnight here"), (6, None)], "review_id long, text string")
    got = {(r.review_id, r.signal): r.value for r in claims.extract_claims(rows, rules).collect()}
    assert got == {(1, "quietness"): "true", (3, "quietness"): "true", (5, "overnight_allowed"): "false"}


def test_payload_and_upsert(spark):
    df = spark.createDataFrame([(1, '{"claims":[{"signal":"q","value":"1","confidence":2}],"tags":[" a ",""],"slope_degrees":50}'), (2, "x"), (3, None)], "spot_id long, payload string")
    got = {r.spot_id: r for r in llm_payload.validated(df, ["q"]).collect()}
    assert got[1].errors == ["claim: q"] and got[1].tags == ["a"] and got[1].slope_degrees is None
    assert got[2].errors == ["payload: not JSON"] == got[3].errors
    a = spark.createDataFrame([(1, 5, "x"), (2, 1, None)], "k int, n int, s string")
    b = spark.createDataFrame([(2, 4, "y"), (3, 9, "z")], "k int, n int, s string")
    assert sorted(map(tuple, reconcile.upsert(a, b, ["k"], {"n": "add", "s": "keep"}).collect())) == [(1, 5, "x"), (2, 5, "y"), (3, 9, "z")]


def test_alert_merge_and_bursts(spark):
    at = AS_OF - timedelta(days=1)
    df = spark.createDataFrame([(1, "theft_risk", 0.9, 0.8, at)] * 3 + [(2, "theft_risk", 0.9, 0.8, at)] * 2, "entity_id long, signal string, value double, confidence double, created_at timestamp")
    assert [(r.entity_id, r.n_claims, round(r.severity, 6)) for r in alerts.bursts(df, ["theft_risk"], AS_OF).collect()] == [(1, 3, 0.8)]


def test_incremental_equals_batch(spark):
    rows = [(i % 3, "s", float(i), True, "x", 0.5, AS_OF - timedelta(days=i), False, i) for i in range(30)]
    obs = _observations(spark, rows)
    whole = incremental.scores(incremental.decayed_sums(obs, 30.0, AS_OF))
    parts = [incremental.decayed_sums(obs.where(F.col("ord") % 2 == k), 30.0, AS_OF) for k in (0, 1)]
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, incremental.scores(incremental.merged_sums(*parts)).collect()))


def test_richness(spark):
    assert one(spark, metrics.richness(F.lit(20), F.lit(15), F.lit(4), F.lit(3))) == pytest.approx(1.0)
    assert one(spark, metrics.richness_level(F.lit(0.3))) == 2
