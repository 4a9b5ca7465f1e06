"""Cleaning, keys and similarities of short multilingual texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: aggregators' domains, which never identify a place.
AGGREGATOR_DOMAINS = (
    "campercontact.com", "park4night.com", "caramaps.com", "stayfree.app", "campspace.com", "vansite.eu",
    "searchforsites.co.uk", "alpacacamping.de", "welcometomygarden.org", "campingcar-infos.com", "freecampsites.net",
    "campernight.com", "bobilguiden.no", "camperstop.com", "campingcarpark.com", "agricamper.it", "roadsurfer.com",
    "campy.app", "campy.nl", "agricamper.com", "thedyrt.com", "campendium.com", "womo-stellplatz.eu", "furgovw.org",
    "nomady.camp", "aireparkreservation.com",
)
#: Platforms and chains that many places share.
SHARED_DOMAINS = (
    "facebook.com", "instagram.com", "sites.google.com", "linktr.ee", "wixsite.com", "google.com/maps", "goo.gl",
    "maps.app.goo.gl", "fs.usda.gov", "blm.gov", "recreation.gov", "nps.gov", "bcparks.ca", "caravanclub.co.uk",
    "campingandcaravanningclub.co.uk", "koa.com", "trafikverket.se",
)
#: Words that count for a language.
LANGUAGE_WORDS = {
    "es": ("el", "la", "con", "para", "noche", "sitio"),
    "fr": ("le", "avec", "pour", "nuit", "endroit"),
    "de": ("der", "die", "mit", "nacht", "platz"),
    "nl": ("het", "een", "met", "nacht", "plek"),
    "en": ("the", "with", "for", "night", "place"),
}
#: Words that alone say nothing about a place.
FILLER_WORDS = ("merci", "thanks", "gracias", "super", "great", "nice", "good", "endroit", "place", "sitio", "spot")
#: Named character references that reviews hold.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def normalize_phone(raw: Column) -> Column:
    """Digits with a leading + for international numbers; null under six digits."""
    s = F.trim(raw)
    digits = F.regexp_replace(s, r"[^\p{Nd}]", "")
    doubled = s.startswith("00")
    digits = F.when(doubled, F.substring(digits, 3, 1 << 30)).otherwise(digits)
    sign = F.when(s.startswith("+") | doubled, "+").otherwise("")
    return F.when(F.length(digits) >= 6, F.concat(sign, digits))


def extract_domain(url: Column, excluded: tuple[str, ...] = AGGREGATOR_DOMAINS + SHARED_DOMAINS) -> Column:
    """Host name without www; null without a dot or for excluded domains, matched anywhere in it."""
    s = F.lower(F.trim(url))
    s = F.regexp_replace(s, r"^.*?://", "")
    s = F.regexp_replace(s, r"[/?#].*$", "")
    s = F.trim(F.regexp_replace(s, r"^www\.", ""), F.lit("."))
    bad = F.exists(F.array(*[F.lit(d) for d in excluded]), lambda d: F.contains(s, d))
    return F.when((s != "") & F.contains(s, F.lit(".")) & ~bad, s)


def kebab(raw: Column) -> Column:
    """Lower case, words joined by single hyphens, only a-z, 0-9 and hyphens."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), r"[_/\s]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9-]", ""), r"-{2,}", "-")
    return F.trim(s, F.lit("-"))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded by two spaces in front and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(
        F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    )


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def token_set(text: Column, longer_than: int = 2) -> Column:
    tokens = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+")
    return F.array_distinct(F.filter(tokens, lambda t: F.length(t) > longer_than))


def keyword_language(text: Column) -> Column:
    """The language with most of its words in the text; ties in the order listed, null without any."""
    s = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    count = lambda t: F.array(*[sum((F.contains(t, F.lit(f" {w} ")).cast("int") for w in ws), F.lit(0)) for ws in LANGUAGE_WORDS.values()])
    first = lambda n: F.when(F.array_max(n) > 0, F.element_at(F.array(*map(F.lit, LANGUAGE_WORDS)), F.array_position(n, F.array_max(n)).cast("int")))
    # by arrays of one element, so the text is lowered and looked through once
    return F.get(F.transform(F.transform(F.array(s), count), first), 0)


def clean_text(text: Column) -> Column:
    """Without character references, tags and URLs; spaces and repeated marks single, lines kept apart by a space."""
    s = F.coalesce(text, F.lit(""))
    for name, char in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(char))
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    s = F.regexp_replace(s, r"https?://\S+|www\.\S+", " ")
    s = F.regexp_replace(s, r"([!?.,])\1{2,}", "$1")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def informative(clean: Column) -> Column:
    """At least ten characters and three words of three letters, and not just filler words."""
    words = F.regexp_count(clean, F.lit(r"[A-Za-zÀ-ÿ]{3,}"))
    filler = F.regexp_like(F.lower(clean), F.lit(r"\b(" + "|".join(FILLER_WORDS) + r")\b"))
    return (F.length(clean) >= 10) & (words >= 3) & ~((words <= 3) & filler)


def excerpt(text: Column, needle: Column, around: int = 40) -> Column:
    """The needle with `around` characters on either side, at its first place."""
    at = F.position(needle, text)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.trim(F.substring(text, start, at - start + F.length(needle) + around)))


#: Parts of addresses that are never a place's own site.
FOREIGN_SITES = (
    "park4night.com", "campercontact.com", "searchforsites.co.uk", "tripadvisor", "facebook.com", "instagram.com", "booking.com", "pitchup.com", "google.com", "caramaps.com", "camping.info",
    "youtube.com", "twitter.com", "x.com", "tiktok.com",
)
_URL = r"https?://[^\s\"'},]+|www\.[^\s\"'},]+"


def official_website(services: Column, description: Column) -> Column:
    """The first address that the services, else the description, name, with its scheme; null if it is another platform's."""
    first = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), _URL, 0), F.lit(""))
    url = F.regexp_replace(F.coalesce(first(services), first(description)), r"[).,\"']+$", "")
    foreign = F.lit(False)
    for part in FOREIGN_SITES:
        foreign = foreign | F.contains(F.lower(url), F.lit(part))
    return F.when(url.isNotNull() & ~foreign, F.when(F.startswith(url, F.lit("www.")), F.concat(F.lit("http://"), url)).otherwise(url))


#: Patterns of filler, each matched in any case, in this order.
FILLER = (
    r"(?:muchas?\s+)?gracias\s+(?:al\s+)?(?:municipio|ayuntamiento|pueblo|town|propietario|owner|gestores?|al\s+municipio)[^.!?]*[.!?]?",
    r"thank\s+you\s+(?:to\s+the\s+)?(?:town|municipality|owner|council)[^.!?]*[.!?]?",
    r"merci\s+(?:à\s+la\s+)?(?:mairie|municipalité|commune|propriétaire)[^.!?]*[.!?]?",
    r"danke\s+(?:an\s+die\s+)?(?:gemeinde|stadt|besitzer)[^.!?]*[.!?]?",
    r"(?:sin\s+duda\s+)?(?:volver(?:emos|é|á)|we(?:'ll|\s+will)\s+(?:be\s+back|return|come\s+back)|on\s+revien(?:dra|t)|wir\s+(?:kommen\s+)?wieder)[^.!?]*[.!?]?",
    r"(?:muy\s+)?recomend(?:ado|able|amos|amos\s+totalmente)[.!]?",
    r"(?:highly\s+)?recommend(?:ed|able)?[.!]?",
    r"(?:je\s+)?recommande(?:\s+vivement)?[.!]?",
    r"empfehlenswert[.!]?",
    r"(?:un\s+)?saludo[s]?[.!]?",
    r"hasta\s+(?:la\s+próxima|pronto|otra)[.!]?",
    r"see\s+you\s+(?:again|next\s+time)[.!]?",
    r"bonne\s+route[.!]?",
    r"gute\s+reise[.!]?",
    r"(?:una\s+)?visita\s+(?:muy\s+)?agradable[.!]?",
    r"(?:a\s+)?nice\s+(?:little\s+)?(?:stop|place|spot)[.!]?",
    r"(?:un\s+)?buen\s+(?:lugar|sitio)\s+para\s+parar[.!]?",
    r"\b[5⭐]{1,5}\s*(?:estrellas|stars|étoiles|sterne)\b[.!]?",
    r"\b10\s*/\s*10\b[.!]?",
    r"como\s+siempre[,.]?",
    r"(?:fuente|source|via)\s*:\s*\S+",
    r"google\s+maps\s+review",
    r"posted\s+(?:on|via)\s+\S+",
)
LEAST_LEFT = 40


def without_filler(text: Column) -> Column:
    """A text without filler; short ones, and those of which too little would be left, stay as they were."""
    cut = text
    for pattern in FILLER:
        cut = F.regexp_replace(cut, "(?iu)" + pattern, " ")
    cut = F.trim(F.regexp_replace(cut, r"\s{2,}", " "))
    return F.when(F.length(text) <= LEAST_LEFT, text).when(F.length(cut) < LEAST_LEFT, F.trim(text)).otherwise(cut)
