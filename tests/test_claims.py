import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.operators import claims, facts, observations
from lodestar.operators.claims import Rule

RULES = (
    Rule("quietness", "0.9", 0.86, ("quiet", "tranquilo", "ruhig")), Rule("quietness", "0.2", 0.84, ("nicht ruhig", "not quiet", "ruidoso")),
    Rule("spot_closed", "true", 0.9, ("closed", "permanently closed")), Rule("spot_closed", "false", 0.8, ("open",)),
    Rule("overnight_safe", "true", 0.8, ("overnight", "slept")), Rule("overnight_safe", "false", 0.9, ("overnight parking prohibited",)),
    Rule("crowd_level", "0.9", 0.8, ("lleno",)), Rule("height", "true", 0.8, ("2.5m", ">7m")), Rule("police_risk", "0.85", 0.9, ("police",)),
    Rule("water_working", "false", 0.9, ("no water",)), Rule("article", "true", 0.5, ("the",)),
)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Not quiet by day. Very quiet at night.", {("quietness", "0.9"), ("quietness", "0.2")}),
        ("without other noise, the lake", {("article", "true")}),
        ("closed in winter, open in summer", {("spot_closed", "true"), ("spot_closed", "false")}),
        ("The toilets were closed. All else fine", {("article", "true")}),
        ("The toilets were permanently closed", {("spot_closed", "true"), ("article", "true")}),
        ("nicht ruhig", {("quietness", "0.2")}),
        ("it wasn't at all quiet", set()),
        ("not one of us had a quiet night", {("quietness", "0.9")}),
        ("unquiet and Quiet!", {("quietness", "0.9")}),
        ("lleno de basura", set()),
        ("lleno de basura, y lleno", {("crowd_level", "0.9")}),
        ("police came", set()),
        ("slept here; overnight parking prohibited", {("overnight_safe", "false")}),
        ("no water because of frost", set()),
        ("there is no water", {("water_working", "false")}),
        ("barrier at 2.5m", {("height", "true")}),
        ("no 2.5m", set()),
        (None, set()),
        ("", set()),
    ],
)
def test_claims(spark, text, want):
    rows = spark.createDataFrame([(1, text)], "review_id long, text string")
    got = claims.extract_claims(rows, RULES).collect()
    assert {(r.signal, r.value) for r in got} == want and len(got) == len(want)


def plain_holds(needle, text):
    """Whether a text in lower case holds a needle that counts, by looking for it alone."""
    for phrase in claims.EXCLUSIONS.get(needle, ()):
        text = text.replace(phrase, " ")
    tokens = lambda x: re.findall(r"[\w']+", x)
    denied = lambda ts: any(t in claims.NEGATIONS or t.endswith("n't") for t in ts)
    pattern = re.escape(needle)
    if re.fullmatch("[a-zà-öø-ÿ' -]+", needle):
        pattern = rf"\b{pattern}\b"
    for m in re.finditer(f"(?={pattern})", text):
        clause = re.split("[.!?;:\n,]", text[:m.start()])[-1]
        whole = clause + re.split("[.!?;:\n,]", text[m.start():])[0]
        if not denied(tokens(needle)) and denied(tokens(clause)[-3:]):
            continue
        if needle in claims.CLOSURES and any(t in claims.FACILITIES for t in tokens(whole)):
            continue
        return True
    return False


def test_automaton_equals_looking_for_each_needle():
    rng = random.Random(7)
    pieces = ["quiet", "not", "pas", "isn't", "lleno", "lleno de basura", "closed", "toilets", "fermé", "ruhig", "4g ok", ">7m", "l'eau", "été", "_", "-", ".", ",", "\n", "3", "no", "wi-fi"]
    needles = {"lleno", "closed", "fermé", "4g ok", ">7m", "no quiet", "l'eau", "wi-fi", "quiet", "uie", "not closed", "été", "'eau", "- "}
    while len(needles) < 764:
        needles.add(rng.choice([" ", "", "-"]).join(rng.choices(pieces[:12] + ["a", "b", "q"], k=rng.randint(1, 3))).strip() or "x")
    needles = sorted(needles)
    rules = tuple(Rule(f"s{k % 30}", "true" if k < 30 else "false", 0.8, tuple(needles[k::60])) for k in range(60))
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice([" ", " ", " ", "", ". "]) for _ in range(rng.randint(0, 25)))
        want = [(k, next(n for n in r.needles if plain_holds(n, text))) for k, r in enumerate(rules) if any(plain_holds(n, text) for n in r.needles)]
        assert claims.held_rules(rules, text) == want


def test_long_texts_without_an_end(spark):
    text = "quiet " * 100_000 + "no " + "quiet " * 3
    rows = spark.createDataFrame([(1, text)], "review_id long, text string")
    assert [r.needle for r in claims.extract_claims(rows, RULES).collect()] == ["quiet"]


def test_vocabulary_from_a_table(spark):
    rows = spark.createDataFrame([(2, 1, "b", "true", 0.5, "Two"), (1, 9, "a", "true", 0.7, "nine"), (1, 2, "a", "true", 0.7, "three")], "rule int, at int, signal string, value string, confidence double, needle string")
    assert claims.rules_of(rows) == (Rule("a", "true", 0.7, ("three", "nine")), Rule("b", "true", 0.5, ("two",)))
    with pytest.raises(ValueError, match="at most 2"):
        claims.rules_of(rows, 2)


def test_ambiguous_signals_are_seen(spark):
    rows = spark.createDataFrame([("Police came",), ("no police",), ("quiet",), (None,)], "text string")
    assert [r[0] for r in rows.select(claims.mentions_ambiguous(rows["text"], RULES)).collect()] == [True, False, False, False]


def test_first_fact_of_a_signal_wins(spark):
    rows = [
        (1, '{"vaciado_negras": false, "vaciado_grises": true, "servicios_extras": {"campfire": false, "bbq": true}}'),
        (2, '{"altura_max_m": "x", "num_plazas": "5", "servicios_extras": "no object", "perros": "Sí"}'),
        (3, None), (4, "broken"), (5, '{"servicios_extras": {"vibes": ["Romantic", "wow_factor"], "prohibitions": ["No overnight camping"], "activities": ["skiing", "MTB"]}}'),
    ]
    got = facts.claims_of_facts(spark.createDataFrame(rows, "record_id long, facts string")).collect()
    assert {(r.record_id, r.signal, r.value) for r in got} == {
        (1, "dump_station_working", "false"), (1, "campfire_allowed", "false"), (2, "parking_capacity", "small"), (2, "dog_friendly", "true"),
        (5, "beauty", "0.8"), (5, "overnight_safe", "false"), (5, "cycling_nearby", "true")}


def test_coercions(spark):
    raw = [("yes",), (" NO ",), ("1",), ("0,5",), ("high",), ("7",), ("-1",), ("NaN",), ("1d",), ("",), (None,), ("1e-1",)]
    rows = spark.createDataFrame(raw, "raw string")
    got = rows.select(observations.as_boolean(rows["raw"]), observations.as_share(rows["raw"])).collect()
    assert [r[0] for r in got] == [True, False, True, None, None, None, None, None, None, None, None, None]
    assert [r[1] for r in got] == [1.0, 0.0, 1.0, 0.5, 0.8, 1.0, 0.0, None, None, None, None, 0.1]


def test_excerpts_are_cut_where_the_text_is_walked(spark):
    """As text.excerpt cuts them, at the needle's first place even if that one is denied, and without a second move of the texts."""
    from lodestar.functions import text as texts

    rows = spark.createDataFrame([(1, "Not quiet, ÉTÉ. So quiet by night"), (2, "  the lake"), (3, "İ ΟΔΟΣ open 𝄞"), (4, None)], "review_id long, text string")
    got = claims.extract_claims(rows, RULES, around=5)
    want = claims.extract_claims(rows, RULES).join(rows, "review_id").select("review_id", "needle", texts.excerpt(F.lower("text"), F.col("needle"), 5).alias("excerpt"))
    shown = lambda df: sorted((r.review_id, r.needle, r.excerpt) for r in df.collect())
    assert shown(got) == shown(want) and len(shown(got)) == 4
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
