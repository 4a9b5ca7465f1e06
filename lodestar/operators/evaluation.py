"""Comparisons of extractors: summaries by model, and differences of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import metrics

#: Calls from which on the 95th percentile is interpolated; below, the greatest stands for it.
LEAST_CALLS = 20


def exclusive_quantile(rows: DataFrame, keys: list[str], value: str, share: tuple[int, int], least: int = LEAST_CALLS) -> DataFrame:
    """Rows (keys, quantile): the quantile share[0]/share[1] by the exclusive method; the maximum of few values.

    The values at the two ranks around (n + 1) * share are kept, no key is gathered.
    """
    some = rows.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys)
    ranked = some.select(*keys, F.col(value).cast("double").alias("v"), F.row_number().over(w.orderBy(value)).alias("at"), F.count(F.lit(1)).over(w).alias("n"))
    at = (F.col("n") + 1) * share[0]
    low = F.least(F.col("n") - 1, F.greatest(F.lit(1), F.floor(at / share[1])))
    part = (at - low * share[1]) / share[1]
    pick = lambda k: F.max(F.when(F.col("at") == low + k, F.col("v")))
    found = ranked.groupBy(*keys).agg(pick(0).alias("a"), pick(1).alias("b"), F.max("v").alias("most"), F.max("n").alias("n"), F.max(part).alias("part"))
    value_at = F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")
    return found.select(*keys, F.when(F.col("n") >= least, value_at).otherwise(F.col("most")).alias("quantile"))


def percent(condition: Column) -> Column:
    """Share of the rows that went well that meet a condition, in percent; 0 if none did."""
    met = F.coalesce(F.sum((F.col("ok") & F.coalesce(condition, F.lit(False))).cast("int")), F.lit(0))
    return F.round(met * 100.0 / F.greatest(F.lit(1), F.count_if("ok")), 1)


def model_summary(calls: DataFrame) -> DataFrame:
    """Calls, failures, latencies, costs and languages of each model.

    calls: model, ok, error, latency, cost, n_claims, spanish, english. Costs and
    latencies are taken in whole millionths, and what is rounded is rounded half up in
    whole numbers, so nothing depends on an order of summing or on a binary fraction;
    costs and counts aren't negative.
    """
    good = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), c)), F.lit(0))
    n_good = lambda c: F.greatest(F.lit(1), F.count(F.when(F.col("ok"), c)))
    millionths = F.round(F.col("cost") * metrics.MILLION).cast("long")
    timed = F.when(F.col("ok") & (F.col("latency") > 0), F.round(F.col("latency") * metrics.MILLION).cast("long"))
    hundredths = lambda c: metrics.rounded_ratio(F.round(c).cast("long"), F.lit(metrics.MILLION // 100)) / 100.0
    late = exclusive_quantile(calls.withColumn("t", timed), ["model"], "t", (19, 20))
    main = calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("parse_ok"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(~F.col("ok") & F.col("error").isNull()).alias("parse_fail"),
        hundredths(F.median(timed)).alias("latency_p50"), (metrics.rounded_ratio(good(millionths), 10 * n_good(millionths)) / 100000.0).alias("cost_avg"),
        (metrics.rounded_ratio(10 * good(F.col("n_claims")), n_good(F.col("n_claims"))) / 10.0).alias("claims_avg"),
        percent(F.col("spanish")).alias("spanish_pct"), percent(F.col("english")).alias("english_pct"),
    )
    return main.join(late, "model", "left").withColumn("latency_p95", hundredths(F.col("quantile"))).drop("quantile")


def claim_differences(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """For each entity and signal that either side has: what changed, and both values.

    Both sides: entity_id, signal, value, one row for each entity and signal.
    """
    a, b = stored.select("entity_id", "signal", F.col("value").alias("old")), fresh.select("entity_id", "signal", F.col("value").alias("new"))
    both = a.join(b, ["entity_id", "signal"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "dropped").when(F.col("old") == F.col("new"), "kept").otherwise("changed")
    return both.select("entity_id", "signal", change.alias("change"), "old", "new")
