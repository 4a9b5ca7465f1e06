"""What is to be done next: pages, queues, pending work, and resets of work that was done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import geo
from lodestar.operators import coincident

#: The order of countries for look-ups; others come last.
COUNTRY_ORDER = "es pt fr it de at ch be nl lu gb ie dk no se fi is pl cz sk hu si hr gr ro bg".split()
#: Fixed values of the adaptive match: metres and similarity, the first that holds counts.
ADAPTIVE = ((30.0, 0.30), (100.0, 0.50))
TEMPERATURES = ("hot", "warm")


def page_after(rows: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next `size` rows above `last`, by key; a page is the feature."""
    later = rows if last is None else rows.where(F.col(key) > F.lit(last))
    return later.orderBy(key).limit(size)


def page_at(rows: DataFrame, order: Sequence[Column], skip: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(size)


def in_given_order(rows: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
    """The rows of the given ids with their place in that list, which the caller orders by."""
    wanted = F.array(*[F.lit(i) for i in ids])
    return rows.where(F.col(key).isin(list(ids))).withColumn("place", F.array_position(wanted, F.col(key).cast("int")))


def missing_downloads(records: DataFrame, reviews: DataFrame, keys: Sequence[str] = ("source", "source_id")) -> DataFrame:
    """Records that announce more reviews than have been loaded, with both numbers.

    records: keys, expected. reviews: keys, review_id; reviews are counted once each and
    before they meet the records. keys are what tells records apart.
    """
    loaded = reviews.groupBy(*keys).agg(F.count_distinct("review_id").alias("loaded"))
    rows = records.join(loaded, list(keys), "left").withColumn("loaded", F.coalesce("loaded", F.lit(0)))
    return rows.where("expected > loaded")


def pending_details(records: DataFrame, payload: str, flag: str, wanted: str) -> DataFrame:
    """Records whose payload has a value at `wanted` and none at `flag`, both JSON paths."""
    at = lambda path: F.get_json_object(F.col(payload), path)
    return records.where(at(wanted).isNotNull() & at(flag).isNull())


def pending_reviews(reviews: DataFrame, spots: DataFrame, credibility: DataFrame, countries: Sequence[str] | None = None) -> DataFrame:
    """Unprocessed reviews with some text, with their place in the queue: hot spots first, newest first.

    reviews: review_id, spot_id, source, body, at, processed. spots: spot_id, country,
    temperature. credibility: source, review_quality. Countries in any case. The place
    is made from counts by (temperature, day), so no task orders the whole queue.
    """
    rows = reviews.where("NOT coalesce(processed, false) AND length(body) > 3").join(spots, "spot_id")
    if countries:
        rows = rows.where(F.lower("country").isin([c.lower() for c in countries]))
    rank = F.when(F.col("temperature") == TEMPERATURES[0], 0).when(F.col("temperature") == TEMPERATURES[1], 1).otherwise(2)
    day = F.coalesce(F.datediff(F.col("at"), F.lit("1970-01-01")), F.lit(-(1 << 30)))
    rows = rows.withColumn("heat", rank).withColumn("day", day).join(credibility, "source", "left")
    days = rows.groupBy("heat", "day").agg(F.count(F.lit(1)).alias("held"))
    ahead = Window.orderBy("heat", F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("heat", "day", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("heat", "day").orderBy(F.desc("at"), F.desc("review_id"))
    placed = rows.withColumn("at_day", F.row_number().over(within)).join(days, ["heat", "day"])
    return placed.select("review_id", "spot_id", F.coalesce("review_quality", F.lit(1.0)).alias("source_confidence"), (F.col("ahead") + F.col("at_day")).alias("place"))


def country_rank(country: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, c in enumerate(COUNTRY_ORDER) for x in (c, i + 1)])
    return F.coalesce(F.try_element_at(table, F.lower(country)), F.lit(99))


def contact_queue(spots: DataFrame, provenance: DataFrame) -> DataFrame:
    """Spots to look contacts up for: those in conflict or without phone or site, with the keys of their order.

    spots: spot_id, country, phone, website. provenance: spot_id, field, conflict.
    """
    torn = provenance.where(F.col("conflict") & F.col("field").isin("phone", "website")).select("spot_id").distinct().withColumn("has_conflict", F.lit(True))
    rows = spots.join(torn, "spot_id", "left").withColumn("has_conflict", F.coalesce("has_conflict", F.lit(False)))
    return rows.where("has_conflict OR phone IS NULL OR website IS NULL").select("spot_id", "has_conflict", country_rank(F.col("country")).alias("country_rank"))


def adaptive_matches(spots: DataFrame, candidates: DataFrame, far_m: float = 150.0, far_similarity: float = 0.6) -> DataFrame:
    """The candidate that each spot is matched to: near with a loose name, farther with a close one.

    spots: spot_id, name, lat, lon. candidates: place_id, place_name, r_lat, r_lon.
    Of those that pass, the most alike counts, then the nearest, then the least id.
    Places meet once, and spots of one name at one place have one answer.
    """
    named = coincident.least_keys(candidates, ["place_name", "r_lat", "r_lon"], "place_id", 1).drop("at")
    pairs = geo.radius_join(spots.select("lat", "lon").distinct(), named, max(far_m, ADAPTIVE[-1][0]) / 1000).withColumn("meters", F.col("dist_km") * 1000)
    # whatever the spot's name, a candidate is beaten by a nearer one of the same name
    nearest = pairs.groupBy("lat", "lon", "place_name").agg(F.min(F.struct(F.round("meters", 6).alias("near"), "place_id", "meters")).alias("x")).select("lat", "lon", "place_name", "x.*")
    by = ["name", "lat", "lon"]
    pairs = coincident.with_similarity(spots.select(*by).distinct().join(nearest, ["lat", "lon"]), "name", "place_name")
    pairs = pairs.withColumn("alike", F.coalesce("similarity", F.lit(0.0)))
    passes = F.lit(False)
    for meters, least in (*ADAPTIVE, (far_m, far_similarity)):
        passes = passes | ((F.col("meters") <= meters) & (F.col("alike") >= least))
    best = pairs.where(passes).groupBy(*by).agg(F.min(F.struct(-F.round("alike", 9), F.col("near").alias("meters"), "place_id")).alias("x"))
    return coincident.back_to_rows(spots.select("spot_id", *by), best, by).select("spot_id", "x.place_id", F.round("x.meters", 2).alias("meters"))


def claimed(jobs: DataFrame, most: int) -> DataFrame:
    """Jobs with the oldest `most` pending ones running; how many run at once is the feature."""
    first = jobs.where("state = 'pending'").orderBy("created_at", "job_id").limit(most).select("job_id", F.lit(True).alias("_now"))
    rows = jobs.join(F.broadcast(first), "job_id", "left")  # at most `most` ids
    return rows.withColumn("state", F.when(F.col("_now"), "running").otherwise(F.col("state"))).drop("_now")


def without_orphans(spots: DataFrame, records: DataFrame) -> DataFrame:
    """Spots whose sources are only those with a record of theirs; without any they are inactive.

    spots: spot_id, sources, active. records: spot_id, source.
    """
    each = spots.select("spot_id", F.explode_outer("sources").alias("source")).distinct()
    kept = each.join(records.select("spot_id", "source").distinct(), ["spot_id", "source"], "left_semi")
    kept = kept.groupBy("spot_id").agg(F.array_sort(F.collect_set("source")).alias("_kept"))
    rows = spots.join(kept, "spot_id", "left").withColumn("sources", F.coalesce("_kept", F.array().cast("array<string>"))).drop("_kept")
    return rows.withColumn("active", F.col("active") & (F.size("sources") > 0))


def reset(reviews: DataFrame, claims: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews of the touched spots unprocessed again, and the claims without those spots' ones."""
    mark = touched.select("spot_id").distinct()
    again = reviews.join(mark.withColumn("_again", F.lit(True)), "spot_id", "left")
    again = again.withColumn("processed", F.when(F.col("_again"), False).otherwise(F.col("processed"))).drop("_again")
    return again, claims.join(mark, "spot_id", "left_anti")


def enriched(spots: DataFrame, records: DataFrame, fill: Sequence[str], unite: Sequence[str]) -> DataFrame:
    """Spots with what their records add: empty columns filled by the earliest value, lists united, sources appended.

    spots: spot_id, type, sources and the columns of fill and unite; records: the same
    with source and seq, the order of ingest. A type only replaces 'otro'.
    """
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("seq")))
    added = records.groupBy("spot_id").agg(
        *[first(c, F.col(c).isNotNull()).alias(f"_{c}") for c in fill],
        first("type", F.col("type").isNotNull() & (F.col("type") != "otro")).alias("_type"),
        F.collect_set("source").alias("_sources"),
        *[F.array_distinct(F.flatten(F.collect_set(c))).alias(f"_{c}") for c in unite],
    )
    rows = spots.join(added, "spot_id", "left")
    none = F.array().cast("array<string>")
    united = lambda c: F.array_sort(F.array_union(F.coalesce(F.col(c), none), F.coalesce(F.col(f"_{c}"), none)))
    return rows.select(
        "spot_id",
        F.when(F.coalesce(F.col("type"), F.lit("otro")) == "otro", F.coalesce("_type", "type")).otherwise(F.col("type")).alias("type"),
        *[F.coalesce(c, f"_{c}").alias(c) for c in fill], *[united(c).alias(c) for c in ("sources", *unite)],
    )
