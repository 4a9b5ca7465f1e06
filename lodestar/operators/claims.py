"""Claims from reviews by rules of needles, with negation, and tags from free text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.needles import Needles

#: Words that deny what follows within three words of the same clause; so does any word that ends in n't.
NEGATIONS = (
    "no", "nunca", "sin", "jamás", "jamas", "tampoco", "prohibido", "prohibida", "prohibidos", "prohibidas",
    "not", "never", "without", "cannot", "cant",
    "nicht", "kein", "keine", "nie", "ohne", "verboten", "untersagt",
    "pas", "sans", "aucun", "aucune", "non", "interdit", "interdite",
)
NEGATION_WORDS = 3
#: Needles of a closure that say nothing where their clause names a service, and the services.
CLOSURES = ("closed", "cerrado", "fermé", "ferme", "geschlossen")
FACILITIES = (
    "toilet", "toilets", "wc", "shower", "showers", "restaurant", "bar", "cafe", "shop", "store", "kiosk", "reception", "office", "pool", "kitchen", "snack",
    "restroom", "restrooms", "bathroom", "laundry", "supermarket", "grocery", "bakery",
    "baño", "ba.os", "baños", "aseo", "aseos", "ducha", "duchas", "restaurante", "kiosco", "quiosco", "supermercado", "chiringuito", "recepción", "recepcion",
    "piscina", "tienda", "lavandería", "lavanderia", "servicio", "servicios", "panadería", "panaderia",
    "toilettes", "sanitaires", "douche", "douches", "piscine", "accueil", "réception", "magasin", "boulangerie", "supermarché", "épicerie",
    "toilette", "toiletten", "dusche", "duschen", "sanitär", "sanitaer", "rezeption", "schwimmbad", "küche", "kueche", "waschraum", "supermarkt", "bäckerei", "baeckerei",
)
#: Phrases that are blanked before a needle is looked for.
EXCLUSIONS = {
    "lleno": (
        "lleno de basura", "lleno de baches", "lleno de barro", "lleno de piedras", "lleno de hojas", "lleno de mierda", "lleno de cristales", "lleno de excrementos",
    ),
}
#: What a text of frost holds; then a tap that doesn't run says nothing.
FREEZE = (
    "helada", "heladas", "helado", "congelad", "hiela", "por el frío", "por el frio", "frozen", "freeze", "freezing", "frost", "iced", "ice",
    "gefroren", "gefrier", "vereist", "gelé", "gelée", "gel ", "givre", "congelé", "ghiacc", "gelo", "congelat", "invierno", "winter", "hiver", "inverno",
)
FROZEN_CLAIM = ("water_working", "false")
#: Signals that no needle decides, and those whose false claim beats the true one.
AMBIGUOUS, FALSE_WINS = ("police_risk",), ("overnight_safe",)
CLAUSE_ENDS = ".!?;:\n,"
#: Needles of one vocabulary at most; it goes to every task.
MOST_NEEDLES = 100_000


class Rule(NamedTuple):
    """A claim and the needles, in lower case, any of which makes it."""

    signal: str
    value: str
    confidence: float
    needles: tuple[str, ...]


def rules_of(rows: DataFrame, most: int = MOST_NEEDLES) -> tuple[Rule, ...]:
    """Rules from a table of needles: rule and at, which order them and their needles, signal, value, confidence, needle.

    Raises if there are more than `most` needles.
    """
    found = rows.orderBy("rule", "at").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a vocabulary holds at most {most} needles")
    rules: dict[object, Rule] = {}
    for r in found:
        known = rules.get(r["rule"])
        rules[r["rule"]] = Rule(r["signal"], r["value"], r["confidence"], (*(known.needles if known else ()), r["needle"].lower()))
    return tuple(rules.values())


_DENYING = frozenset(NEGATIONS)


def _denies(token: str) -> bool:
    return token in _DENYING or token.endswith("n't")


@lru_cache(maxsize=4)
def _needles(rules: tuple[Rule, ...]) -> tuple[Needles, list[list[tuple[int, int]]]]:
    """The automaton of a vocabulary, and of each of its needles the rules that hold it with its place there; built once in a worker."""
    of: dict[str, list[tuple[int, int]]] = {}
    for k, rule in enumerate(rules):
        for at, needle in enumerate(rule.needles):
            of.setdefault(needle, []).append((k, at))
    return Needles(list(of), _denies, NEGATION_WORDS, CLAUSE_ENDS, EXCLUSIONS, CLOSURES, FACILITIES), list(of.values())


def held_rules(rules: tuple[Rule, ...], text: str) -> list[tuple[int, str]]:
    """Rules that a text holds, by place, each with the first of its needles that counts; the first rule of a claim stands for it."""
    low = text.lower()
    needles, holding = _needles(rules)
    first: dict[int, int] = {}
    for i in needles.found(low):
        for k, at in holding[i]:
            first[k] = min(at, first.get(k, at))
    out, seen = [], set()
    for k in sorted(first):
        rule = rules[k]
        claim = (rule.signal, rule.value)
        if claim in seen or claim == FROZEN_CLAIM and any(f in low for f in FREEZE):
            continue
        seen.add(claim)
        out.append((k, rule.needles[first[k]]))
    return out


def excerpt_of(low: str, needle: str, around: int) -> str | None:
    """The needle with `around` characters on either side, at its first place in a text in lower case; null if it isn't there."""
    at = low.find(needle)
    return None if at < 0 else low[max(at - around, 0):at + len(needle) + around].strip(" ")


def _holding(rules: Sequence[Rule], around: int | None = None):
    """A column function of a text, and of the text in lower case where excerpts are wanted: the rules that it holds."""
    rules = tuple(rules)
    said = [("rule", pa.int32()), ("needle", pa.string())]
    shown = T.StructType().add("rule", "integer").add("needle", "string")
    if around is None:

        @F.arrow_udf(T.ArrayType(shown))
        def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([[(k, n) for k, n in held_rules(rules, t)] for t in batch.to_pylist()], pa.list_(pa.struct(said)))

        return held

    @F.arrow_udf(T.ArrayType(shown.add("excerpt", "string")))
    def held_with_excerpts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([*said, ("excerpt", pa.string())]))
        for batch, lows in batches:
            yield pa.array([[(k, n, excerpt_of(low, n, around)) for k, n in held_rules(rules, t)] for t, low in zip(batch.to_pylist(), lows.to_pylist(), strict=True)], kind)

    return held_with_excerpts


def extract_claims(reviews: DataFrame, rules: Sequence[Rule], text: str = "text", key: str = "review_id", around: int | None = None) -> DataFrame:
    """Rows (key, signal, value, confidence, needle): the claims that a review's text makes, each once.

    The vocabulary is one automaton that walks each text once; needle is the first of
    the rule's that counts. Null texts make no claims. With `around` there is a column
    excerpt, the needle's first place in the text in lower case with as many characters
    on either side: cut where the text is walked, so texts don't move.
    """
    rules = [r for r in rules if r.signal not in AMBIGUOUS]
    if not rules:
        rules = [Rule("", "", 0.0, ())]
    whole = F.coalesce(text, F.lit(""))
    held = _holding(rules)(whole) if around is None else _holding(rules, around)(whole, F.lower(whole))
    extra = [] if around is None else ["excerpt"]
    made = F.array(*[F.struct(F.lit(r.signal).alias("signal"), F.lit(r.value).alias("value"), F.lit(r.confidence).alias("confidence")) for r in rules])
    rows = reviews.select(key, held.alias("_held"))
    claims = rows.select(key, F.transform("_held", lambda h: F.struct(F.element_at(made, h["rule"] + 1).alias("claim"), *[h[c].alias(c) for c in ("needle", *extra)])).alias("_made"))
    beaten = lambda c: c["claim"]["signal"].isin(*FALSE_WINS) & (c["claim"]["value"] == "true") & F.exists(
        "_made", lambda o: (o["claim"]["signal"] == c["claim"]["signal"]) & (o["claim"]["value"] == "false"))
    return claims.select(key, F.explode(F.filter("_made", lambda c: ~beaten(c))).alias("_c")).select(key, "_c.claim.*", "_c.needle", *[f"_c.{c}" for c in extra])


def mentions_ambiguous(text: Column, rules: Sequence[Rule]) -> Column:
    """Whether a text names a signal that needles don't decide."""
    rules = [r for r in rules if r.signal in AMBIGUOUS]
    return F.size(_holding(rules)(F.coalesce(text, F.lit("")))) > 0 if rules else F.lit(False)


def should_escalate(mode: str, text: Column, n_claims: Column, ambiguous: Column) -> Column:
    """Whether a review goes on to a language model."""
    if mode == "regex_only":
        return F.lit(False)
    if mode == "llm_only":
        return F.length(text) >= 30
    return ambiguous | ((F.length(text) >= 120) & (n_claims < 3))


def grounding(excerpt: Column, text: Column, least: float = 0.34) -> Column:
    """Whether enough of an excerpt's words of four characters or more occur in the text; repeated words count."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda w: F.length(w) >= 4)
    own = words(excerpt)
    hit = F.size(F.filter(own, lambda w: F.array_contains(words(text), w)))
    return F.when(F.size(own) > 0, hit / F.size(own) >= least).otherwise(False)


def canonical_tags(rows: DataFrame, aliases: DataFrame, key: str, tags: str) -> tuple[DataFrame, DataFrame]:
    """(key, canonical tags in order without repeats), (unknown tag, count). aliases: alias, tag."""
    from lodestar.functions.text import kebab

    each = rows.select(key, F.posexplode(tags).alias("pos", "raw")).withColumn("alias", kebab(F.col("raw"))).where("alias <> ''")
    first = aliases.groupBy("alias").agg(F.min("tag").alias("tag"))
    joined = each.join(first, "alias", "left")
    known = joined.where("tag IS NOT NULL").groupBy(key, "tag").agg(F.min("pos").alias("pos"))
    listed = known.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("tags"))
    return listed, joined.where("tag IS NULL").groupBy("alias").agg(F.count(F.lit(1)).alias("n"))
