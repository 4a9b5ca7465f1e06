"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents stand in the
order of (key, size, text hash); prefix sums of their word counts over that
order say where the source's budget is used up. The prefix sums are distributed:
key ranges are summed first, a running sum over the ranges finds the one that
holds the cut, and only that range's rows are ordered. Sources may be as many as
hosts: their order, and the sums over it that the targets need, are made the same
way, by ranges of sources. The result of all this is
one small row for each source, the cut, which each document is compared with. The
cuts are a written table: where it is small, Spark broadcasts it and documents
don't move; beyond that documents are dealt by source and salt.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; a source without words has target 0; an empty table gives an empty
result; rows that are equal in key, size and text and stand at the cut share what
is left of the budget equally, rounded down. Rows of the input travel within one
column, so other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that a key range holds on average, and bounds on the number of ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 2048, 64, 65536
#: Parts that the rows of one source are dealt to.
SALTS = 16


def _same(a, b):
    return a.eqNullSafe(b)


def _marks(seed: int, id_col: str, text_col: str, source_col: str, prefix: str = "") -> list[Column]:
    """Source, size, key and tie of a row whose columns stand behind `prefix`."""
    text = F.col(f"{prefix}{text_col}")
    return [
        F.col(f"{prefix}{source_col}").alias("source"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("mix_size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"{prefix}{id_col}").cast("string"), F.lit("")))).alias("mix_key"),
        F.xxhash64(text).alias("mix_tie"),
    ]


def running(rows: DataFrame, order: list[Column], values: list[str], name: str) -> DataFrame:
    """`rows` with before_v, the sum of v over all rows in front in `order`, for each v of `values`.

    Rows are dealt to ranges of the order and summed by range; a running sum over
    the ranges, of which there are as many as partitions, leads each of them. The
    order must tell all rows apart.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), name)
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range").agg(*[F.sum(v).alias(v) for v in values])
    sums = sums.select(F.col("range"), *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"ahead_{v}") for v in values])
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"within_{v}") for v in values])
    found = found.join(F.broadcast(sums), "range")  # one row for each partition
    return found.select(*rows.columns, *[(F.col(f"ahead_{v}") + F.col(f"within_{v}")).alias(f"before_{v}") for v in values])


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share=(3, 2), cap: int = 2) -> DataFrame:
    """Budget of each source, from rows (source, source_size).

    Sources in code-point order, null last, take `weights` in turn and share
    share[0]/share[1] of all sizes; none gets more than `cap` times its size, and
    what is above goes to the others by weight. With the sources ordered by cap
    over weight those that reach their cap come first, so one pass finds the level.
    """
    rows = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], ["one"], "mix-sources")
    rows = rows.select("source", "source_size", F.col("before_one").alias("place"))
    picked = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", picked.cast("long")).withColumn("most", F.col("source_size") * cap)
    rows = rows.withColumn("ratio", F.col("most") / F.col("weight"))
    rows = written(running(rows, [F.col("ratio"), F.col("place")], ["most", "weight"], "mix-ratios"), "mix-levels")
    of_all = lambda c: rows.agg(F.sum(c)).scalar()
    level = (of_all("source_size") * share[0] - share[1] * F.col("before_most")) / (share[1] * (of_all("weight") - F.col("before_weight")))
    free = rows.withColumn("level", level).where(F.col("ratio") > F.col("level"))
    final = free.agg(F.min_by("level", F.struct("ratio", "place"))).scalar()
    rows = rows.withColumn("scaled", F.col("weight") * final)
    capped = F.col("scaled").isNull() | (F.col("scaled") > F.col("most"))
    return rows.select("source", "source_size", F.when(capped, F.col("most").cast("double")).otherwise(F.col("scaled")).alias("target"))


def _cuts(keyed: DataFrame, weights, share, cap) -> DataFrame:
    """One row for each source: target, full epochs, and the cut of the last one."""
    rows = keyed.count()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, 1 << (max(1, rows // RANGE_ROWS) - 1).bit_length()))
    width = 65536 // ranges
    key_range = F.floor(F.conv(F.substring("mix_key", 1, 4), 16, 10).cast("long") / width).alias("mix_range")
    keyed = keyed.select("source", "mix_size", "mix_key", "mix_tie", key_range)
    sums = keyed.groupBy("source", "mix_range").agg(F.sum("mix_size").alias("range_size"))
    sizes = sums.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    words = F.floor("target").cast("long")
    size = F.col("source_size")
    epochs = F.when(size > 0, F.floor(words / size)).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", words - F.col("epochs") * size)
    t = targets.withColumnRenamed("source", "t_source")
    over_ranges = Window.partitionBy("source").orderBy("mix_range")
    cut_range = (
        sums.withColumn("upto", F.sum("range_size").over(over_ranges))
        .join(t, _same(F.col("source"), F.col("t_source")))
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("range_size") <= F.col("rest")))
        .select(
            F.col("source").alias("c_source"),
            F.col("mix_range").alias("c_range"),
            (F.col("rest") - F.col("upto") + F.col("range_size")).alias("left"),
        )
    )
    within = Window.partitionBy("c_source").orderBy("mix_key", "mix_size", "mix_tie")
    cut = (
        keyed.join(cut_range, _same(F.col("source"), F.col("c_source")) & (F.col("mix_range") == F.col("c_range")))
        .groupBy("c_source", "mix_key", "mix_size", "mix_tie", "left")
        .agg(F.count(F.lit(1)).alias("equal"))
        .withColumn("upto", F.sum(F.col("mix_size") * F.col("equal")).over(within))
        .withColumn("before", F.col("upto") - F.col("mix_size") * F.col("equal"))
        .where((F.col("before") <= F.col("left")) & (F.col("upto") > F.col("left")))
        .select(
            "c_source",
            F.struct("mix_key", "mix_size", "mix_tie").alias("cut"),
            F.floor((F.col("left") - F.col("before")) / F.col("equal")).cast("long").alias("partial"),
        )
    )
    found = t.join(cut, _same(F.col("t_source"), F.col("c_source")), "left").drop("c_source", "rest")
    return written(found, "mix-cuts").withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share=(3, 2), cap: int = 2, seed: int = 0,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (row, size, source_size, target, taken): each row of `docs` as a struct, and what the mix takes of it.

    taken counts the words that the mix takes from the row: its size for each
    full epoch of its source, and its size, a part of it or nothing in the last.
    """
    light = written(docs.select(*_marks(seed, id_col, text_col, source_col)), "mix-sizes")
    cuts = _cuts(light, weights, share, cap)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return _taken(rows.select("row", *_marks(seed, id_col, text_col, source_col, "row.")), cuts)


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows (..., size, source_size, target, taken) of rows (..., source, mix_size, mix_key, mix_tie)."""
    carried = [c for c in rows.columns if c not in ("source", "mix_size", "mix_key", "mix_tie")]
    mark = F.struct("mix_key", "mix_size", "mix_tie")
    size = F.col("mix_size")
    last = F.when(mark < F.col("cut"), size).when(mark == F.col("cut"), F.col("partial")).otherwise(0)
    taken = size * F.coalesce(F.col("epochs"), F.lit(0)) + F.coalesce(last, F.lit(0))
    rows = rows.withColumn("salt", F.pmod(F.coalesce(F.col("mix_tie"), F.lit(0)), F.lit(SALTS)).cast("int"))
    return rows.join(cuts, _same(F.col("source"), F.col("t_source")) & (F.col("salt") == F.col("t_salt"))).select(
        *carried, size.alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each taken row of `docs` as often as the mix takes it.

    The row at a source's cut stays whole.
    """
    taken = mix_sources(docs, **options).where("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return taken.select("row", F.explode(F.sequence(F.lit(1), copies)).alias("copy")).select("row.*")


def op8_mix_sources(docs: DataFrame) -> DataFrame:
    """Digest of the mix: one row for each document."""
    keyed = written(docs.select("doc_id", *_marks(0, "doc_id", "text", "source")), "mix-sizes")
    return _taken(keyed, _cuts(keyed, (3, 1, 2), (3, 2), 2))


OP8_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place, source_size * 2 AS most FROM src
), weighted AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM placed
), levels AS (
  SELECT *, CAST(most AS DOUBLE) / weight AS ratio,
         CAST(sum(source_size) OVER () * 3
              - 2 * coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, place
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(2 * sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, place
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighted
), final AS (
  SELECT (SELECT level FROM levels WHERE ratio > level ORDER BY ratio, place LIMIT 1) AS lam
), tgt AS (
  SELECT source, source_size,
         CASE WHEN lam IS NULL OR weight * lam > most THEN CAST(most AS DOUBLE) ELSE weight * lam END AS target
  FROM levels, final
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM tgt
), summed AS (
  SELECT b.doc_id, b.size, c.source_size, c.target, c.epochs,
         CAST(floor(c.target) AS BIGINT) - c.epochs * c.source_size AS rest,
         CAST(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k, b.size
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - b.size AS before
  FROM base b JOIN cut c ON b.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * epochs + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM summed
"""
