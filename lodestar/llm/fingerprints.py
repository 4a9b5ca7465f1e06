"""Document fingerprints by consistent weighted sampling.

A text's terms are its word shingles, weighted by how often they occur. For each
of SAMPLES draws, every term has three numbers that depend on the term and the
draw alone: r and c, gamma distributed with shape 2, and b, uniform. With
t = floor(ln(weight) / r + b) the term's key is c * exp(-r * (t + 1 - b)), and the
draw's sample is the term of least key, with its t. Two texts have an equal sample
with the probability of their generalised Jaccard similarity, the sum of lesser
weights over the sum of greater ones, so the share of equal samples estimates it.

Only DataFrame functions run. The gamma numbers come from tables of quantiles,
picked by bits of one hash of term and draw. Each draw's least is a minimum of
whole numbers whose high bits are the logarithm of the key and whose low bits name
the sample, so one hash aggregation by text makes all draws at once.

Neighbours are found within buckets of consecutive documents, which are ranges of
(id, text hash), so an id that many documents share is cut too; the first document
of a bucket also goes to the bucket in front, which needs it. That is the only move
of texts: terms, draws and comparisons stay where the bucket is. Buckets are sorted
and walked through with spill, so none has to fit in memory; they hold about
BUCKET_ROWS documents until there are MOST_CUTS of them, whose first keys every
task looks up, and grow beyond that.

Defined results: a null text is empty; a text of fewer words than a shingle has
its word sequence as one term; a text without words has an empty fingerprint,
which is like another empty one (1) and unlike all else (0); null ids stand below
all others; documents of one id are ordered by text hash; repeated rows get
results of their own; with one document the next one is itself; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.scratch import written

SAMPLES, WIDTH = 32, 5
#: Entries of the quantile tables; documents of one bucket of neighbours; first keys of buckets, 16 bytes each, that a task looks up.
TABLE, BUCKET_ROWS, MOST_CUTS = 4096, 512, 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def _quantile(p: Column) -> Column:
    """Quantile of the gamma distribution of shape 2, whose tail at x is (1 + x) exp(-x), by halving."""

    def halve(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        below = -F.expm1(-mid) - mid * F.exp(-mid) < p
        return F.struct(F.when(below, mid).otherwise(s["a"]).alias("a"), F.when(below, s["b"]).otherwise(mid).alias("b"))

    start = F.struct(F.lit(0.0).alias("a"), F.lit(64.0).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda s: (s["a"] + s["b"]) / 2)


def gamma_table(spark: SparkSession, parts: Sequence[float], logarithm: bool) -> DataFrame:
    """One row v: quantiles at the middles of TABLE parts of (0, high) for each high in `parts`, or their logarithms.

    Worked out from the row's id, so that plans don't carry the numbers.
    """
    def table(high: float) -> Column:
        def quantile(i: Column) -> Column:
            q = _quantile((i + F.col("id") + 0.5) * F.lit(high / TABLE))
            return F.ln(q) if logarithm else q

        return F.transform(F.sequence(F.lit(0), F.lit(TABLE - 1)), quantile)

    tables = [table(high) for high in parts]
    return spark.range(1).select(F.concat(*tables).alias("v"))


def draws(spark: SparkSession, samples: int = SAMPLES) -> tuple[list[Column], list[Column]]:
    """Columns to add to rows (term, lw), and for each draw an aggregate over them.

    lw is the logarithm of the term's weight. The aggregate is the least of a
    whole number whose order is that of the draw's key. c's table holds its
    quantiles and, in front of them, finer ones of the lowest part, where the
    least keys come from.
    """
    # scalar subqueries: each runs once, and all expressions share its array
    r_table = gamma_table(spark, [1.0], False).scalar()
    c_table = gamma_table(spark, [1.0 / TABLE, 1.0], True).scalar()
    term, lw, low = F.col("term"), F.col("lw"), F.lit(4294967295)
    part = lambda h, at: F.shiftrightunsigned(h, at).bitwiseAND(F.lit(TABLE - 1)).cast("int")
    hashes, out = [], []
    for k in range(samples):
        hashes.append(F.xxhash64(term, F.lit(k)).alias(f"h{k}"))
        h = F.col(f"h{k}")
        r = F.get(r_table, part(h, 0))
        b = F.shiftrightunsigned(h, 36) * F.lit(2.0**-28)
        c = F.get(c_table, F.when(part(h, 12) == 0, part(h, 24)).otherwise(part(h, 12) + TABLE))
        t = F.floor(lw / r + b)
        key = ((c - r * (t + 1.0 - b) + 96.0) * 16777216.0).cast("bigint")
        name = term.bitwiseXOR(t * 40503).bitwiseAND(low)
        out.append(F.min(F.shiftleft(key, 32).bitwiseOR(name)).alias(f"d{k}"))
    return hashes, out


def _apart(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """`rows` with a column that later expressions read and never work out again."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def sorted_terms(rows: DataFrame, text: str, width: int = WIDTH) -> DataFrame:
    """`rows` with terms: the sorted hashes of the text's shingles."""
    rows = _apart(rows, "found", F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).drop(text)
    rows = _apart(rows, "words", F.transform("found", lambda w: F.xxhash64(w))).drop("found")
    words, n = F.col("words"), F.size("words")
    many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    few = F.when(n > 0, F.array(F.xxhash64(F.lit(width), words))).otherwise(F.array().cast("array<bigint>"))
    return _apart(rows, "terms", F.sort_array(F.when(n >= width, many).otherwise(few))).drop("words")


def _runs(column: str) -> Column:
    """Values of a sorted array with the logarithms of their counts."""
    starts = F.filter(
        F.sequence(F.lit(0), F.size(column) - 1), lambda i: (i == 0) | (F.get(column, i) != F.get(column, i - 1))
    )
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(column)))
    pairs = F.zip_with(starts, ends, lambda a, b: F.struct(F.get(column, a).alias("term"), F.ln((b - a).cast("double")).alias("lw")))
    plain = F.transform(F.col(column), lambda t: F.struct(t.alias("term"), F.lit(0.0).alias("lw")))
    distinct = F.size(F.array_distinct(column)) == F.size(column)
    return F.when(distinct, plain).otherwise(pairs)


def signatures(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES, width: int = WIDTH) -> DataFrame:
    """Rows (keys, samples): the names of each text's samples; null for a text without words.

    Where `rows` are dealt by some of the keys already, nothing moves.
    """
    listed = sorted_terms(rows.select(*keys, text), text, width)
    each = listed.select(*keys, F.explode_outer(_runs("terms")).alias("x")).select(*keys, "x.term", "x.lw")
    hashes, least = draws(rows.sparkSession, samples)
    mins = each.select("*", *hashes).groupBy(*keys).agg(*least)
    found = F.array(*[F.col(f"d{k}").bitwiseAND(F.lit(4294967295)) for k in range(samples)])
    return mins.select(*keys, F.when(F.col("d0").isNotNull(), found).alias("samples"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; without words, 1 for two such texts and 0 else."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(samples))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(equal)


def _text_of(samples: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def bucketed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of `docs` dealt to buckets of neighbours: (bucket, borrowed, place, tie, id, text).

    (place, tie) ascends as ids descend. A bucket holds what is from its first key
    on and in front of the next bucket's; rows of that next key also stand, as
    borrowed, at its end, and those of the very first key at the end of the last.
    """
    place = F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).alias("place")
    tie = F.xxhash64(text_col).alias("tie")
    light = written(docs.select(place, tie), "neighbour-keys")
    parts = max(1, min(MOST_CUTS, -(-light.count() // BUCKET_ROWS)))
    ranged = light.repartitionByRange(parts, "place", "tie").groupBy(F.spark_partition_id().alias("part"))
    firsts = sorted(tuple(r["first"]) for r in ranged.agg(F.min(F.struct("place", "tie")).alias("first")).collect())  # one for each bucket
    text = json.dumps([{"place": p, "tie": t} for p, t in firsts])
    cuts = F.from_json(F.lit(text), "array<struct<place:bigint,tie:bigint>>")
    steps = F.array(*[F.lit(1 << i) for i in range(len(firsts).bit_length() - 1, -1, -1)] or [F.lit(1)])
    key = F.struct("place", "tie")
    # how many first keys are not above the row's, by binary search
    upto = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(cuts, at + s - 1) <= key, at + s).otherwise(at))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), place, tie).withColumn("at", upto - 1)
    is_first = F.get(cuts, F.col("at")) == key
    copies = F.filter(
        F.array(
            F.struct(F.col("at").alias("bucket"), F.lit(0).alias("borrowed")),
            F.when(is_first & (F.col("at") > 0), F.struct((F.col("at") - 1).alias("bucket"), F.lit(1).alias("borrowed"))),
            F.when(is_first & (F.col("at") == 0), F.struct(F.lit(len(firsts) - 1).alias("bucket"), F.lit(2).alias("borrowed"))),
        ),
        lambda c: c.isNotNull(),
    )
    return rows.withColumn("c", F.explode(copies)).select("c.bucket", "c.borrowed", "place", "tie", "id", "text")


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES,
                           width: int = WIDTH) -> DataFrame:
    """Rows (id, n_chars, edited_sha256, samples, edited_samples, next_samples), one for each row of `docs`.

    The edited text has its last third replaced by the beginning of the next
    document, in descending order of ids.
    """
    order = ["borrowed", "place", "tie"]
    window = Window.partitionBy("bucket").orderBy(*order)
    rows = bucketed(docs, id_col, text_col)
    rows = rows.withColumn("at", F.row_number().over(window)).withColumn("next_text", F.lead("text").over(window))
    n = F.length("text")
    take = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - take), F.substring(F.col("next_text"), F.lit(1), take))
    rows = rows.where((F.col("borrowed") == 0) | (F.col("at") > 0)).withColumn("edited", F.when(F.col("borrowed") == 0, edited))
    both = rows.select(
        "bucket", "at", "id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.posexplode(F.when(F.col("borrowed") == 0, F.array("text", "edited")).otherwise(F.array("text"))).alias("version", "content"),
    )
    signed = signatures(both, ["bucket", "at", "version", "id", "n_chars", "edited_sha256"], "content", samples, width)
    follow = Window.partitionBy("bucket").orderBy("at", "version")
    return (
        signed.withColumn("edited_samples", F.lead("samples", 1).over(follow))
        .withColumn("next_samples", F.lead("samples", 2).over(follow))
        .where((F.col("version") == 0) & F.col("edited_sha256").isNotNull())
        .select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "samples", "edited_samples", "next_samples")
    )


def op6_fingerprints(docs: DataFrame) -> DataFrame:
    """Digest of the fingerprints: one row for each document."""
    found = neighbour_fingerprints(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _text_of(F.col("samples")).alias("fingerprint"),
        _text_of(F.col("edited_samples")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
        likeness(F.col("samples"), F.col("next_samples")).alias("near_next"),
    )
