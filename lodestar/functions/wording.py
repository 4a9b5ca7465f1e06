"""States and texts in words: compact descriptions, fingerprints, intents, hints, language priors."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signal and its short name, in the order of a description.
DSL_KEYS = {
    "quietness": "quiet",
    "noise": "noise",
    "road_noise": "road_noise",
    "party_noise": "party_noise",
    "train_noise": "train_noise",
    "police_risk": "police",
    "theft_risk": "theft",
    "beauty": "beauty",
    "safety": "safe",
    "crowd_level": "crowd",
    "stealth": "stealth",
    "road_quality": "road",
    "wind_exposure": "shelter",
    "cleanliness": "clean",
    "sea_view": "sea",
    "mountain_view": "mountain",
    "shade_morning": "shade_am",
    "shade_afternoon": "shade_pm",
    "overnight_safe": "overnight",
    "large_vehicle": "bigveh",
    "lake_nearby": "lake",
    "noise_source": "noisesrc",
    "parking_capacity": "parking",
}
#: Signals whose high values are bad.
HIGHER_IS_WORSE = ("noise", "road_noise", "party_noise", "train_noise", "police_risk", "theft_risk", "crowd_level", "wind_exposure")
#: Words of hints, and how many a text of that language has at least.
SPANISH_HINTS = "el la los las un una de del y con en para sin que por".split()
ENGLISH_HINTS = "the of and with for is are to in by on at".split()
LEAST_HINTS, LEAST_HINT_CHARS = 3, 20
#: Fixed values: (detected, expected) pairs that short texts are confused in, and the language meant.
CONFUSIONS = {
    ("it", "es"): "es",
    ("pt", "es"): "es",
    ("ro", "es"): "es",
    ("it", "ca"): "es",
    ("pt", "ca"): "es",
    ("ro", "ca"): "es",
    ("it", "pt"): "pt",
    ("ro", "pt"): "pt",
    ("es", "pt"): "pt",
    ("es", "it"): "it",
    ("pt", "it"): "it",
    ("ro", "it"): "it",
}
CONFUSED_CHARS = 80
#: The languages that texts about a country are expected in, the first the most.
COUNTRY_LANGUAGES = {
    "ES": ("es", "ca", "gl", "eu"), "PT": ("pt",), "AD": ("ca", "es", "fr"),
    "FR": ("fr",), "MC": ("fr",), "LU": ("fr", "de"),
    "DE": ("de",), "AT": ("de",), "CH": ("de", "fr", "it"), "LI": ("de",),
    "IT": ("it",), "SM": ("it",), "VA": ("it",),
    "NL": ("nl",), "BE": ("nl", "fr", "de"),
    "GB": ("en",), "UK": ("en",), "IE": ("en",), "US": ("en",), "CA": ("en", "fr"), "AU": ("en",), "NZ": ("en",),
    "DK": ("da",), "SE": ("sv",), "NO": ("no",), "FI": ("fi", "sv"), "IS": ("is",),
    "PL": ("pl",), "CZ": ("cs",), "SK": ("sk",), "HU": ("hu",), "SI": ("sl",), "HR": ("hr",), "RO": ("ro",), "BG": ("bg",),
    "EE": ("et",), "LV": ("lv",), "LT": ("lt",),
    "GR": ("el",), "TR": ("tr",),
    "MX": ("es",), "AR": ("es",), "CL": ("es",), "CO": ("es",), "PE": ("es",), "BR": ("pt",),
}
#: Prefixes and suffixes that aggregators put on names, stripped in this order.
NAME_PATTERNS = (r"(?i)^Campspace\s+in\s+", r"(?i)^WTMG\s+in\s+", r"(?i)^Nomady\s+", r"(?i)^Park4Night\s+", r",\s+[A-Za-zÀ-ž\-\s]{6,}$")
#: Dollars for a million tokens: input, output, cached input.
PRICES = {
    "gemini-2.5-flash": (0.30, 2.50, 0.075),
    "gemini-2.5-flash-lite": (0.10, 0.40, 0.025),
    "gemini-flash-latest": (0.30, 2.50, 0.075),
    "deepseek-v4-flash": (0.14, 0.28, 0.0028),
    "deepseek-v4-pro": (0.435, 0.87, 0.003625),
    "deepseek-chat": (0.14, 0.28, 0.0028),
}
#: Filter, its value, and the words of a question that set it.
INTENTS = (
    ("quietness_score_min", "0.7", ("tranquil", "tranquilo", "tranquila", "quiet", "calm", "silenc")),
    ("safety_score_min", "0.6", ("seguro", "safe", "safety", "sicher")),
    ("beauty_score_min", "0.6", ("bonito", "buenas vistas", "beautiful", "view", "vistas")),
    ("police_risk_score_max", "0.3", ("policia", "police", "multa", "fine", "molesten", "control")),
    ("stealth_score_min", "0.6", ("policia", "police", "multa", "fine", "molesten", "control")),
    ("overnight_safe", "true", ("pernoct", "overnight", "dormir", "sleep")),
    ("crowd_level_score_max", "0.4", ("solitario", "solo", "poca gente", "sin gente", "uncrowded")),
    ("perros", "true", ("perro", "dog", "dogs", "chien", "hund")),
    ("gratuito", "true", ("gratis", "gratuito", "free")),
    ("wifi", "true", ("wifi",)),
    ("ducha", "true", ("ducha", "shower", "douche")),
    ("agua_potable", "true", ("agua", "water", "eau", "wasser")),
)
CAMPING_WORDS, WILD_WORDS = ("camping", "campsite"), ("wild", "naturaleza", "libre")
#: Weight of a term's own prior beside a score.
PRIOR_WEIGHT = 0.3


def _folds() -> dict[str, str]:
    """Letters of Latin script that are one plain letter and combining marks, by Unicode's decomposition."""
    table = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(plain) == 1 and plain[0] != chr(code):
            table[chr(code)] = plain[0]
    return table


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    table = _folds()
    plain = F.translate(F.lower(text), "".join(table), "".join(table.values()))
    return F.regexp_replace(plain, r"\p{Mn}+", "")


def truncated(text: Column, most: int) -> Column:
    """At most `most` characters, the last of them an ellipsis where text is cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def bare_name(name: Column) -> Column:
    """A name without what aggregators put around it; never empty unless it was."""
    clean = F.coalesce(name, F.lit(""))
    for pattern in NAME_PATTERNS:
        clean = F.trim(F.regexp_replace(clean, pattern, ""))
    return F.when(clean == "", F.coalesce(name, F.lit(""))).otherwise(clean)


def hints(text: Column, words: list[str]) -> Column:
    """How many words of the text are among `words`."""
    return F.size(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w.isin(words)))


def looks_like(text: Column, words: list[str]) -> Column:
    """Whether a text long enough has some of a language's words."""
    return F.coalesce((F.length(text) >= LEAST_HINT_CHARS) & (hints(text, words) >= LEAST_HINTS), F.lit(False))


def expected_languages(country: Column) -> Column:
    """What languages a country's texts are expected in; none for a country that isn't known, or null."""
    table = F.create_map(*[x for c, ls in COUNTRY_LANGUAGES.items() for x in (F.lit(c), F.array(*map(F.lit, ls)))])
    return F.coalesce(F.try_element_at(table, F.upper(country)), F.array().cast("array<string>"))


def language_with_prior(detected: Column, text: Column, expected: Column) -> Column:
    """The detected language, unless a short text shows a known confusion with the first of the `expected` ones."""
    pair = F.concat_ws(">", detected, F.get(expected, 0))
    table = F.create_map(*[F.lit(x) for (a, b), meant in CONFUSIONS.items() for x in (f"{a}>{b}", meant)])
    confused = ~F.array_contains(expected, detected) & (F.length(text) < CONFUSED_CHARS)
    return F.when(F.coalesce(confused, F.lit(False)), F.coalesce(F.try_element_at(table, pair), detected)).otherwise(detected)


def blended(score: Column, prior: Column) -> Column:
    """A score with the prior of the strongest term found, or as it is without one."""
    mixed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - PRIOR_WEIGHT) * score + PRIOR_WEIGHT * prior))
    return F.when(prior.isNull(), score).otherwise(mixed)


def term_prior(text: Column, terms: dict[str, float]) -> Column:
    """The greatest prior of the terms that the folded text holds, or null."""
    folded = fold(text)
    return F.array_max(F.array(*[F.when(F.contains(folded, F.lit(t)), F.lit(p)) for t, p in terms.items()]))


def token_cost(model: Column, tokens: Column, cached: Column, out: Column) -> Column:
    """Dollars of a call; 0 for a model without a price."""
    price = [F.create_map(*[F.lit(x) for m, p in PRICES.items() for x in (m, p[k])]) for k in range(3)]
    at = lambda k: F.try_element_at(price[k], model)
    fresh = F.greatest(F.lit(0), tokens - cached)
    return F.coalesce((fresh * at(0) + cached * at(2) + out * at(1)) / 1e6, F.lit(0.0))


def fingerprint(parts: dict[str, Column]) -> Column:
    """Sixteen hex digits over named parts; arrays count as sets in order, null as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.concat(F.lit(f"{k}:"), F.coalesce(c, F.lit(""))) for k, c in parts.items()])), 1, 16)


def listed(items: Column) -> Column:
    return F.array_join(F.array_sort(items), ",")


def question_filters(question: Column) -> Column:
    """Filters that a question's words set, as map<string, string>."""
    q = F.lower(question)
    any_of = lambda words: F.greatest(*[F.contains(q, F.lit(w)).cast("int") for w in words], F.lit(0)) == 1
    pairs = [F.when(any_of(words), F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"))) for k, v, words in INTENTS]
    kind = F.when(any_of(CAMPING_WORDS), "camping").when(any_of(WILD_WORDS), "naturaleza")
    pairs.append(F.when(kind.isNotNull(), F.struct(F.lit("tipo").alias("k"), kind.alias("v"))))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))


def compact_description(scores: DataFrame) -> DataFrame:
    """Rows (entity_id, dsl): the known signals of each entity in order, with sign for good and bad.

    scores: entity_id, signal, score_num, score_bool, score_text, one row for each
    entity and signal; signals are a fixed list, so an entity's rows are few.
    """
    keys = {k: i for i, k in enumerate(DSL_KEYS)}
    of = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col("signal"))
    worse = F.col("signal").isin(*HIGHER_IS_WORSE)
    good = F.when(worse, 0.5 - F.col("score_num")).otherwise(F.col("score_num") - 0.5)
    number = F.concat(F.when(good >= 0, "+").otherwise("-"), F.format_string("%.1f", F.least(F.lit(1.0), F.abs(good) * 2)))
    text = F.when(F.col("score_text") != "", F.substring(F.replace(F.col("score_text"), F.lit(" "), F.lit("_")), 1, 24))
    value = F.when(F.col("score_bool").isNotNull(), F.when(F.col("score_bool"), "T").otherwise("F")).when(F.col("score_num").isNotNull(), number).otherwise(text)
    rows = scores.where(F.col("signal").isin(*keys)).select("entity_id", of(keys).alias("at"), F.concat(of(DSL_KEYS), F.lit(":"), value).alias("part")).where("part IS NOT NULL")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])
    return rows.groupBy("entity_id").agg(F.array_join(parts, " ").alias("dsl"))


def embedding_text(spot: dict[str, Column], score: dict[str, Column]) -> Column:
    """A place in sentences for embedding: name and type, summary, tags, what its scores say, services.

    spot: name, type, region, country, summary, tags, best_for, season, services, dsl.
    score: numbers or booleans by signal; those left out or null say nothing.
    """
    get = lambda k: score.get(k, F.lit(None))
    above = lambda k, at, words: F.when(get(k) > at, words)
    below = lambda k, at, words: F.when(get(k) < at, words)
    holds = lambda k, words: F.when(get(k).cast("boolean"), words)
    said = F.concat_ws(
        ". ",
        F.coalesce(above("quietness", 0.7, "lugar muy tranquilo y silencioso"), below("quietness", 0.3, "ruidoso, cerca de carretera o zona urbana")),
        F.coalesce(above("beauty", 0.7, "entorno bonito con buenas vistas"), below("beauty", 0.3, "entorno poco atractivo")),
        F.coalesce(above("safety", 0.7, "zona segura"), below("safety", 0.3, "zona con problemas de seguridad")),
        F.coalesce(above("police_risk", 0.5, "riesgo de control policial o multa"), below("police_risk", 0.2, "sin problemas con policia")),
        F.coalesce(holds("overnight_safe", "se puede pernoctar"), F.when(~get("overnight_safe").cast("boolean"), "pernocta prohibida o arriesgada")),
        above("stealth", 0.7, "discreto, bueno para pernocta libre"),
        F.coalesce(above("crowd_level", 0.7, "muy masificado"), below("crowd_level", 0.3, "poco frecuentado, solitario")),
        holds("sea_view", "vistas al mar"), holds("mountain_view", "vistas a montana"), holds("lake_nearby", "cerca de un lago"),
        holds("shade_morning", "sombra por la manana"), holds("shade_afternoon", "sombra por la tarde"),
        above("wind_exposure", 0.7, "expuesto al viento"), below("road_quality", 0.3, "acceso dificil, pista o camino en mal estado"),
        below("large_vehicle", 0.3, "no apto para vehiculos grandes"),
    )
    has = lambda c: c.isNotNull() & (c != "")
    part = lambda label, c: F.when(has(c), F.concat(F.lit(label), c))
    parts = [
        F.concat(F.coalesce(spot["name"], F.lit("Spot sin nombre")), F.lit(" - "), F.coalesce(spot["type"], F.lit("spot"))),
        F.when(has(spot["region"]), F.concat(F.lit("en "), spot["region"], F.lit(", "), F.upper(F.coalesce(spot["country"], F.lit(""))))),
        part("", spot["summary"]), part("Tags: ", F.array_join(spot["tags"], ", ")), part("Ideal para: ", F.array_join(spot["best_for"], ", ")),
        part("Mejor epoca: ", spot["season"]), part("", said), part("Servicios: ", F.array_join(spot["services"], ", ")), part("DSL: ", spot["dsl"]),
    ]
    return F.trim(F.concat_ws(". ", *parts))
