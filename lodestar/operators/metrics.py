"""Scores and reports: popularity, coverage, candidates, histograms, duplicate groups."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.state import at_time

#: Fixed values of candidate selection.
LEAST_REVIEWS, LEAST_NEW, STALE_MONTHS = 3, 5, 18


MILLION = 1_000_000


def rounded_ratio(part: Column, whole: Column) -> Column:
    """part / whole of non-negative whole numbers, rounded half up, as a whole number."""
    return F.call_function("div", 2 * part + whole, 2 * whole)


def _saturated(n: Column, full: int) -> Column:
    return F.least(F.ln((n + 1).cast("double")) / F.ln(F.lit(float(full))), F.lit(1.0))


def recency_steps(last: Column, as_of: datetime) -> Column:
    since = lambda days: last > at_time(as_of) - F.expr(f"INTERVAL {days} DAYS")
    return F.when(last.isNull(), 0.0).when(since(90), 1.0).when(since(365), 0.7).when(since(730), 0.3).otherwise(0.1)


def popularity(spots: DataFrame, reviews: DataFrame, as_of: datetime) -> DataFrame:
    """Log-saturated counts of reviews and sources, and steps of recency, in three decimals."""
    per = reviews.groupBy("spot_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("s"), F.max("at").alias("last"))
    rows = spots.join(per, "spot_id", "left")
    n, s = F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0))
    score = 0.5 * _saturated(n, 51) + 0.3 * _saturated(s, 5) + 0.2 * recency_steps(F.col("last"), as_of)
    return rows.select("spot_id", n.alias("n_reviews"), s.alias("n_sources"), F.round(score, 3).alias("popularity"))


def reliability(spots: DataFrame, records: DataFrame, reviews: DataFrame, credibility: DataFrame, as_of: datetime) -> DataFrame:
    """Mean credibility of a spot's sources, their number, and whether it has reviews, also recent ones.

    Credibilities are summed in whole millionths and the score is rounded once, half
    up, in whole numbers, so it depends on no order of summing.
    """
    millionths = F.round(F.coalesce("base_score", F.lit(0.5)) * MILLION).cast("long")
    per = records.join(credibility, "source", "left").groupBy("spot_id").agg(
        F.sum(millionths).alias("base"), F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("s"))
    seen = reviews.groupBy("spot_id").agg(F.max("at").alias("last"))
    rows = spots.join(per, "spot_id", "left").join(seen, "spot_id", "left")
    recent = F.coalesce(F.col("last") > at_time(as_of) - F.expr("INTERVAL 180 DAYS"), F.lit(False))
    tenths = F.least(F.coalesce("s", F.lit(0)), F.lit(3)) + 2 * F.col("last").isNotNull().cast("int") + recent.cast("int")
    base, n = F.coalesce("base", F.lit(MILLION // 2)), F.coalesce("n", F.lit(1))
    of_base = rounded_ratio(400 * base, n * MILLION)
    return rows.select("spot_id", ((of_base + 100 * tenths) / 1000.0).alias("reliability"))


def histogram(scores: DataFrame, column: str) -> DataFrame:
    return scores.groupBy(F.round(column, 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def percentage(condition: Column) -> Column:
    """Share of rows that meet the condition, in percent with two decimals; null without rows."""
    return F.round(F.count_if(condition) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), 2)


def provenance_coverage(votes: DataFrame) -> DataFrame:
    return votes.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "set").alias("n_decided"), F.count_if("conflict").alias("n_conflicts"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"))


def source_stats(records: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row for each source of either table, each aggregated before they meet."""
    a = records.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_chars").alias("total_chars"), F.max("n_chars").alias("longest"))
    b = labelled.groupBy("source").agg(F.count(F.lit(1)).alias("n_labelled"), F.sum("toxic").alias("n_toxic"), F.sum("quality").alias("n_good"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "source", "full_outer").select("source", zero("n_records"), zero("total_chars"), "longest", zero("n_labelled"), zero("n_toxic"), zero("n_good"))


def labelled_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()])


def duplicate_groups(rows: DataFrame, shown: int = 10) -> DataFrame:
    """Keys with several rows and the first ids of each, joined by commas; no more than those are gathered."""
    some = rows.where("key IS NOT NULL")
    at = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    first = some.withColumn("_at", at).where(F.col("_at") <= shown).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    counted = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.join(first, "key").select("key", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("first_ids"))


def enrichment_candidates(spots: DataFrame, reviews: DataFrame, version: int, as_of: datetime, limit: int) -> DataFrame:
    """Active spots with enough reviews that need enrichment, the most pressing first."""
    per = spots.where("active").join(reviews, "spot_id").groupBy("spot_id", "version", "stale", "aggregated_at").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count_if(F.col("first_seen") > F.col("aggregated_at")).alias("n_new"))
    behind = F.coalesce(F.col("version") < version, F.lit(False))
    old = F.col("aggregated_at") < at_time(as_of) - F.expr(f"INTERVAL {STALE_MONTHS} MONTHS")
    due = F.col("version").isNull() | behind | F.col("stale") | F.coalesce(old, F.lit(False)) | (F.col("n_new") >= LEAST_NEW)
    rows = per.where((F.col("n_reviews") >= LEAST_REVIEWS) & due).withColumn("version_behind", behind)
    return rows.orderBy(F.desc("version_behind"), F.desc("stale"), F.desc("n_reviews"), "spot_id").limit(limit)


def month_round_robin(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Rows with place: by rounds over the months of a key, each round from the newest month on."""
    month = F.coalesce(F.year(at) * 12 + F.month(at) - 1, F.lit(-1))
    rows = rows.withColumn("_month", month)
    rows = rows.withColumn("_round", F.row_number().over(Window.partitionBy(key, "_month").orderBy(F.desc(at), tie)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_round", F.desc("_month"), tie))).drop("_month", "_round")


def token_budget(rows: DataFrame, key: str, order: list[Column], tokens: Column, budget: int) -> DataFrame:
    """Rows of each key in order until their tokens exceed the budget; the first always stays."""
    rows = rows.withColumn("tokens", tokens)
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("total", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_at", F.row_number().over(w))
    return rows.where((F.col("total") <= budget) | (F.col("_at") == 1)).drop("_at")


def richness(n_reviews: Column, services: Column, languages: Column, sources: Column) -> Column:
    part = lambda c, full: F.least(c / full, F.lit(1.0))
    return F.round(0.5 * part(n_reviews, 20) + 0.3 * part(services, 15) + 0.1 * part(languages, 4) + 0.1 * part(sources, 3), 3)


def richness_level(score: Column) -> Column:
    return F.when(score >= 0.8, 4).when(score >= 0.55, 3).when(score >= 0.3, 2).when(score >= 0.1, 1).otherwise(0)
