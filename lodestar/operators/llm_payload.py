"""Validation of a language model's JSON about a place, item by item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "struct<claims:array<struct<signal:string,value:string,confidence:double,review_id:string,excerpt:string>>,"
    "alerts:array<struct<alert_type:string,severity:double,confidence:double,valid_from_inferred:string,source_review_ids:array<string>,summary:string>>,"
    "cross_references:array<struct<mentioned_name:string,relation_type:string,review_id:string,excerpt:string>>,"
    "summary:string,tags:array<string>,best_for:array<string>,elevation_m:int,slope_degrees:int>"
)
MOST_TAGS, TAG_CHARS = 12, 60
#: How a place may relate to another one that a review names.
RELATIONS = ("alternative_overnight", "service_provider_for", "parking_for_visit", "same_complex", "walking_distance")
NAME_CHARS, EXCERPT_CHARS = 200, 500


def _unfenced(raw: Column) -> Column:
    return F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", "")


def _strings(items: Column) -> Column:
    """At most twelve trimmed strings of at most sixty characters, without blanks."""
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda s: F.substring(F.trim(s), 1, TAG_CHARS)), lambda s: s != "")
    return F.slice(kept, 1, MOST_TAGS)


def _within(value: Column, low: int, high: int) -> Column:
    return F.when(value.between(low, high), value)


def validated(payloads: DataFrame, signals: list[str], key: str = "spot_id", raw: str = "payload") -> DataFrame:
    """One row for each payload: valid items and an array of errors; broken JSON is one error."""
    doc = F.coalesce(F.from_json(_unfenced(F.col(raw)), SCHEMA), F.from_json(F.get_json_object(F.concat(F.lit('{"x":'), F.col(raw), F.lit("}")), "$.x"), SCHEMA))
    # text that isn't JSON parses to a struct of nulls
    broken = F.try_parse_json(_unfenced(F.col(raw))).isNull()
    rows = payloads.select(key, F.when(~broken, doc).alias("d"))
    known = F.array(*map(F.lit, signals))
    claims = F.coalesce(F.col("d.claims"), F.array().cast("array<struct<signal:string,value:string,confidence:double,review_id:string,excerpt:string>>"))
    good = lambda c: F.coalesce(F.array_contains(known, c["signal"]) & c["value"].isNotNull() & c["confidence"].between(0, 1), F.lit(False))
    alerts = F.coalesce(F.col("d.alerts"), F.array().cast("array<struct<alert_type:string,severity:double,confidence:double,valid_from_inferred:string,source_review_ids:array<string>,summary:string>>"))
    fine = lambda a: F.coalesce((a["alert_type"] != "") & a["severity"].between(0, 1) & a["confidence"].between(0, 1), F.lit(False))
    references = F.coalesce(F.col("d.cross_references"), F.array().cast("array<struct<mentioned_name:string,relation_type:string,review_id:string,excerpt:string>>"))
    related = lambda r: F.coalesce((F.trim(r["mentioned_name"]) != "") & F.lower(F.trim(r["relation_type"])).isin(*RELATIONS), F.lit(False))
    tidy = lambda r: F.struct(
        F.substring(F.trim(r["mentioned_name"]), 1, NAME_CHARS).alias("mentioned_name"), F.lower(F.trim(r["relation_type"])).alias("relation_type"),
        r["review_id"].try_cast("long").alias("review_id"), F.substring(F.coalesce(r["excerpt"], F.lit("")), 1, EXCERPT_CHARS).alias("excerpt"))
    errors = F.concat(
        F.when(F.col("d").isNull(), F.array(F.lit("payload: not JSON"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(claims, lambda c: ~good(c)), lambda c: F.concat(F.lit("claim: "), F.coalesce(c["signal"], F.lit("?")))),
        F.transform(F.filter(alerts, lambda a: ~fine(a)), lambda a: F.concat(F.lit("alert: "), F.coalesce(a["alert_type"], F.lit("?")))),
        F.transform(F.filter(references, lambda r: ~related(r)), lambda r: F.concat(F.lit("reference: "), F.coalesce(r["relation_type"], F.lit("?")))),
    )
    return rows.select(
        key, F.filter(claims, good).alias("claims"), F.filter(alerts, fine).alias("alerts"), F.transform(F.filter(references, related), tidy).alias("cross_references"), _strings(F.col("d.tags")).alias("tags"), _strings(F.col("d.best_for")).alias("best_for"),
        F.trim("d.summary").alias("summary"), _within(F.col("d.elevation_m"), -500, 9000).alias("elevation_m"), _within(F.col("d.slope_degrees"), 0, 45).alias("slope_degrees"),
        errors.alias("errors"),
    )
