"""Line dedup by site-relative frequency.

For each host, a line's ratio is the pages that contain it over the pages of the
host. Lines above the boilerplate ratio go. Lines are compared without their
outer white space, by a 128-bit hash; blank lines are never counted or dropped. A
line that only one page of the host holds doesn't repeat and stays, whatever the
ratio: on a host of under ten pages all lines would go otherwise.

Pages are rows, or, with `distinct_pages`, different texts: then copies of a page
count as one page, so a document doesn't lose its lines for being copied, which
is for document dedup to judge.

A host has at most (mean lines of its pages / ratio) boilerplate lines, so the
set is one short array for each host. Pages are dealt to it by host and salt,
never by host alone; where the whole set is small, Spark broadcasts it and pages
don't move at all.

Defined results: a null text stays null and counts as a page without lines; a
null host is a host of its own; repeated rows are pages of their own (one page
with `distinct_pages`); an empty table gives an empty result; other columns stay
as they are, whatever their names, but one named as `removed_col` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.scratch import written

RATIO, LEAST_PAGES = 0.1, 2
SALTS = 16
#: White space that lines are compared without.
OUTER = " \t\r\x0b\x0c"


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(OUTER))


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(_bare(line)).alias("a"), F.xxhash64(F.lit(1), _bare(line)).alias("b"))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                least_pages: int = LEAST_PAGES, distinct_pages: bool = False) -> DataFrame:
    """Rows (host, lines): hashes of the lines in more than `ratio` of the host's pages."""
    text = F.col(text_col)
    page = [F.xxhash64(text), F.xxhash64(F.lit(1), text)] if distinct_pages else []
    names = ["page_a", "page_b"][: len(page)]
    pages = docs.select(F.col(host_col).alias("host"), F.split(text, "\n").alias("lines"),
                        *[c.alias(n) for c, n in zip(page, names, strict=True)])
    totals = pages.groupBy("host").agg((F.count_distinct(F.struct(*names)) if names else F.count(F.lit(1))).alias("pages"))
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.array_distinct(F.transform(F.filter("lines", lambda x: _bare(x) != ""), _hash))
    held = pages.select("host", *names, F.explode(own).alias("line"))
    if names:  # one row for each line of a text, however many copies it has
        held = held.groupBy("host", "line", *names).agg(F.count(F.lit(1)).alias("copies"))
    counted = (
        held.groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("holding"))
        .where(F.col("holding") >= least_pages)
        .withColumn("salt", F.pmod(F.col("line.a"), F.lit(SALTS)).cast("int"))
    )
    t = totals.select(F.col("host").alias("t_host"), "pages", F.col("salt").alias("t_salt"))
    frequent = counted.join(t, counted["host"].eqNullSafe(t["t_host"]) & (F.col("salt") == F.col("t_salt"))).where(
        F.col("holding") > F.col("pages") * F.lit(float(ratio))
    )
    return frequent.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def dedup_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                least_pages: int = LEAST_PAGES, distinct_pages: bool = False, removed_col: str = "lines_removed") -> DataFrame:
    """The rows of `docs` with boilerplate lines gone from the text, and the number of lines removed."""
    found = written(boilerplate(docs, host_col, text_col, ratio, least_pages, distinct_pages), "boilerplate")
    found = found.select(
        F.col("host").alias("b_host"), F.col("lines").alias("b_lines"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("b_salt"),
    )
    columns = [c for c in docs.columns if c != removed_col]
    # columns of `docs` travel within one, so that no name of theirs meets a name of ours
    rows = docs.select(F.struct(*columns).alias("row")).withColumn("salt", F.pmod(F.xxhash64(f"row.{text_col}"), F.lit(SALTS)).cast("int"))
    rows = rows.join(found, F.col(f"row.{host_col}").eqNullSafe(F.col("b_host")) & (F.col("salt") == F.col("b_salt")), "left")
    text = F.col(f"row.{text_col}")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("b_lines"), _hash(x)))
    clean = F.when(F.col("b_lines").isNull(), text).otherwise(F.array_join(kept, "\n"))
    removed = F.when(text.isNull() | F.col("b_lines").isNull(), 0).otherwise(F.size(lines) - F.size(kept))
    rows = rows.select("row", clean.alias("clean"), removed.cast("long").alias("removed"))
    return rows.select(*[F.col("clean" if c == text_col else f"row.{c}").alias(c) for c in columns], F.col("removed").alias(removed_col))


def op3_line_dedup(docs: DataFrame) -> DataFrame:
    """One row for each document: its text without boilerplate, and the lines that went."""
    return dedup_lines(docs.select("doc_id", "source", "text")).select("doc_id", "source", "lines_removed", "text")


OP3_SQL = """
WITH page AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), total AS (
  SELECT source, count(*) AS pages FROM page GROUP BY source
), bare AS (
  SELECT *, ' ' || chr(9) || chr(13) || chr(11) || chr(12) AS outer_space FROM page
), line AS (
  SELECT DISTINCT rid, source, trim(x, outer_space) AS line
  FROM (SELECT rid, source, outer_space, unnest(lines) AS x FROM bare) WHERE trim(x, outer_space) <> ''
), found AS (
  SELECT l.source, list(l.line) AS drops FROM (
    SELECT source, line, count(*) AS holding FROM line GROUP BY source, line HAVING count(*) >= 2
  ) l JOIN total t ON l.source IS NOT DISTINCT FROM t.source
  WHERE holding > pages * CAST(0.1 AS DOUBLE) GROUP BY l.source
), cleaned AS (
  SELECT p.*, f.drops,
         list_filter(p.lines, lambda x: NOT coalesce(list_contains(f.drops, trim(x, p.outer_space)), false)) AS kept
  FROM bare p LEFT JOIN found f ON p.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, source, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS lines_removed,
       CASE WHEN text IS NULL OR drops IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text
FROM cleaned
"""
