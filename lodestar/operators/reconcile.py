"""Field values from many sources into one: votes, rankings, overrides, merges, upserts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import checkpointed

#: Fixed values of the vote and of temporal overrides.
TIE_MARGIN, DEFAULT_WEIGHT = 0.10, 0.5
OVERRIDE_COUNT, OVERRIDE_WEIGHT, OVERRIDE_CONFIDENCE, OVERRIDE_DAYS = 2, 1.5, 0.7, 60


def weighted_vote(values: DataFrame, credibility: DataFrame) -> DataFrame:
    """One row for each (entity, field): value, witness, supporters, confidence, margin, conflict, decision.

    values: entity_id, field, source, value, source_rank, record_id; of several
    records of a source the last counts, of equal record ids the greater value. credibility: source, base_score; sources
    without one weigh DEFAULT_WEIGHT. A margin under TIE_MARGIN keeps what stands.
    """
    kept = F.max_by(F.struct("value", "source_rank", "record_id"), F.struct("record_id", "value")).alias("x")  # aggregated before it moves
    rows = values.where("value IS NOT NULL").groupBy("entity_id", "field", "source").agg(kept).select("entity_id", "field", "source", "x.*")
    rows = rows.join(credibility.select("source", "base_score"), "source", "left")
    rows = rows.withColumn("vote", F.coalesce("base_score", F.lit(DEFAULT_WEIGHT)))
    rank = F.struct(F.coalesce("source_rank", F.lit(1 << 30)), F.col("record_id"))
    by_value = rows.groupBy("entity_id", "field", "value").agg(
        F.sum("vote").alias("weight"), F.count(F.lit(1)).alias("supporters"), F.min_by("source", rank).alias("witness")
    )
    order = Window.partitionBy("entity_id", "field").orderBy(F.desc("weight"), F.desc("value"))
    best = by_value.withColumn("_at", F.row_number().over(order)).groupBy("entity_id", "field").agg(
        F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n_values"),
        F.max(F.struct("weight", "value", "supporters", "witness")).alias("first"),
        F.sum("supporters").alias("n_sources"), F.max(F.when(F.col("_at") == 2, F.col("weight"))).alias("second"),
    )
    second = F.coalesce("second", F.lit(0.0))
    margin = (F.col("first.weight") - second) / F.col("total")
    tie = F.round(margin, 9) < TIE_MARGIN
    return best.select(
        "entity_id", "field",
        F.when(~tie, F.col("first.value")).alias("value"),
        F.when(~tie, F.col("first.witness")).alias("witness"),
        F.when(~tie, F.col("first.supporters")).alias("supporters"),
        F.round(F.col("first.weight") / F.col("total"), 6).alias("confidence"),
        F.round(margin, 6).alias("margin"),
        (F.col("n_values") > 1).alias("conflict"),
        F.when(tie, "keep_existing").otherwise("set").alias("decision"),
        "n_sources",
    )


def rank_first(values: DataFrame) -> DataFrame:
    """The value of each (entity, field)'s best-ranked source; ranks are by field, unranked sources last."""
    rank = F.struct(F.coalesce("source_rank", F.lit(1 << 30)), F.col("record_id"))
    return values.where("value IS NOT NULL").groupBy("entity_id", "field").agg(F.min_by(F.struct("value", "source"), rank).alias("x")).select(
        "entity_id", "field", "x.value", F.col("x.source").alias("witness")
    )


def conflicts(values: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(entity, field) with more than one distinct value."""
    rows = values.where("value IS NOT NULL")
    rows = rows.where(F.col("field").isin(fields)) if fields else rows
    return rows.groupBy("entity_id", "field").agg(F.count_distinct(F.col("value").cast("string")).alias("n_values")).where("n_values > 1")


def temporal_overrides(states: DataFrame, fields_of_signal: dict[str, tuple[str, ...]], as_of: datetime) -> DataFrame:
    """Negative overrides: well-supported false signals switch their fields off until one half-life later.

    states: entity_id, signal, score_bool, confidence, support, n_observations, half_life.
    """
    fields = F.create_map(*[x for k, v in fields_of_signal.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    sure = (
        (F.col("score_bool") == F.lit(False)) & (F.col("n_observations") >= OVERRIDE_COUNT)
        & (F.col("support") >= OVERRIDE_WEIGHT) & (F.col("confidence") >= OVERRIDE_CONFIDENCE)
    )
    days = F.coalesce("half_life", F.lit(OVERRIDE_DAYS)).cast("int")
    return states.where(sure).select(
        "entity_id", F.explode(F.get(F.array(fields[F.col("signal")]), F.lit(0))).alias("field"), F.col("signal").alias("source_signal"),
        F.date_add(F.lit(as_of.date().isoformat()).cast("date"), days).alias("expires_on"),
    )


def merge_amenities(records: DataFrame, key: str, booleans: list[str], scalars: list[str], arrays: list[str], order: str) -> DataFrame:
    """One row for each key: booleans true if any is, first known scalars in `order`, arrays united."""
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return records.groupBy(key).agg(
        *[F.bool_or(c).alias(c) for c in booleans],
        *[known(c).alias(c) for c in scalars],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in arrays],
    )


#: What an upsert does with a column: old and new values to the stored one.
POLICIES = {
    "keep": lambda old, new: F.coalesce(old, new),
    "take": lambda old, new: F.coalesce(new, old),
    "greatest": lambda old, new: F.greatest(old, new),
    "least": lambda old, new: F.least(old, new),
    "add": lambda old, new: F.when(old.isNull() & new.isNull(), None).otherwise(F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))),
    "union": lambda old, new: F.array_sort(F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))))),
}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policies: dict[str, str]) -> DataFrame:
    """Both tables as one: rows of either, columns by policy. `new` has a row for a key at most."""
    columns = [*keys, *policies]
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in policies])
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in policies])
    merged = o.join(n, keys, "full_outer")
    return merged.select(*keys, *[POLICIES[p](F.col(f"_o_{c}"), F.col(f"_n_{c}")).alias(c) for c, p in policies.items()]).select(*columns)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`old` and the first row of each of `new`'s keys that it lacks; null keys are equal."""
    first = new.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")
    seen = old.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & first[k].eqNullSafe(seen[f"_k_{k}"])
    return old.unionByName(first.join(seen, same, "left_anti"))


def merge_ends(mapping: DataFrame) -> DataFrame:
    """Rows (old_id, new_id): where merges over merges end. mapping: old_id, new_id, one step each.

    Of several steps from one id the smallest new_id counts. Ids that merge in a circle,
    and those that lead to it, end at the circle's smallest id. What ends at itself, and
    null ids, have no row. Each round doubles the steps, so rounds grow with the logarithm
    of the longest chain, or of the number of ids that circles hold and draw in.
    """
    steps = mapping.where("old_id IS NOT NULL AND new_id IS NOT NULL AND old_id <> new_id").groupBy("old_id").agg(F.min("new_id").alias("at"))
    led = checkpointed(steps.select("old_id", "at", F.col("old_id").alias("least")))
    taken, before = 1, None
    while True:
        on = led.select(F.col("old_id").alias("at"), F.col("at").alias("further"), F.col("least").alias("ahead"))
        both = led.join(on, "at", "left")
        going = both.where("further IS NOT NULL").count()
        if going == 0 or going == before and taken >= going:  # no chain ended, so what goes on leads to circles, which were gone round
            break
        before = going
        led = checkpointed(both.select("old_id", F.coalesce("further", "at").alias("at"), F.least("least", F.coalesce("ahead", "least")).alias("least")))
        taken *= 2
    circle = led.select(F.col("old_id").alias("at"), F.col("least").alias("end"))
    return led.join(circle, "at", "left").select("old_id", F.coalesce("end", "at").alias("new_id")).where("old_id <> new_id")


def remap(children: DataFrame, mapping: DataFrame, key: str, duplicate_keys: list[str] | None = None) -> DataFrame:
    """`children` with merged parents' ids replaced; mapping: old_id, new_id, of `merge_ends` where merges follow merges. Of equal children the first stays."""
    moved = children.join(mapping.select(F.col("old_id").alias(key), "new_id"), key, "left")
    moved = moved.withColumn(key, F.coalesce("new_id", key)).drop("new_id").select(*children.columns)
    if duplicate_keys:
        rest = [c for c in moved.columns if c not in duplicate_keys]
        return moved.groupBy(*duplicate_keys).agg(F.min(F.struct(*rest)).alias("x")).select(*[c if c in duplicate_keys else F.col(f"x.{c}").alias(c) for c in moved.columns])
    return moved
