"""Plain distributed prefix doubling: the repeated strings of a corpus by sorted pairs of ranks.

Every position of every text gets a rank by the bytes that follow it, first eight
of them; Spark sorts pairs (rank of the position, rank of the position so many
bytes on) at growing offsets and ranks them anew, until a rank is unique, when its
position leaves, or `length` bytes are reached. What shares a rank then starts a
string that also starts elsewhere.

This is the method as it stands, all in DataFrame functions. Each offset moves a
row of some 30 bytes for each byte of text several times, so `suffix_dedup` settles
most positions another way; tests hold both to the same result on small tables.

Defined results: a null text is empty; texts shorter than `length` have no
positions; repeated rows are documents of their own; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.mix_sources import running
from lodestar.llm.scratch import written

#: Bytes of the first ranks, as many as a whole number holds.
FIRST = 8


def _ranked(pairs: DataFrame) -> DataFrame:
    """Rows (doc, pos, rank) of rows (doc, pos, rank, next): pairs in order have ranks in order; those of one position leave."""
    held = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("held")).where("held > 1").withColumn("one", F.lit(1).cast("long"))
    order = running(held.select("rank", "next", "one"), [F.col("rank"), F.col("next")], ["one"], "pair-order")
    return pairs.join(order.select("rank", "next", F.col("before_one").alias("new")), ["rank", "next"]).select("doc", "pos", F.col("new").alias("rank"))


def repeated_starts(docs: DataFrame, text_col: str = "text", length: int = 200) -> DataFrame:
    """Rows (doc, pos): row number and byte where a string of `length` bytes starts that also starts elsewhere."""
    if length < FIRST:
        raise ValueError("length must be eight or more")
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    texts = written(docs.select(F.monotonically_increasing_id().alias("doc"), data.alias("data")).where(F.length("data") >= length), "doubling-texts")
    each = texts.select("doc", "data", F.explode(F.sequence(F.lit(0), F.length("data") - FIRST)).alias("pos"))
    number = F.conv(F.hex(F.substring(F.col("data"), F.col("pos") + 1, F.lit(FIRST))), 16, -10).cast("long")
    ranks = written(_ranked(each.select("doc", "pos", number.alias("rank"), F.lit(0).cast("long").alias("next"))), "ranks")
    reach = FIRST
    while reach < length:
        step = min(reach, length - reach)
        on = ranks.select("doc", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        ranks = written(_ranked(ranks.join(on, ["doc", "pos"])), "ranks")
        reach += step
    return ranks.select("doc", "pos")
