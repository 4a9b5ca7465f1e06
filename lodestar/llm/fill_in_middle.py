"""Fill-in-middle transformation by a sparse checkpoint index.

A text's units are words with the white space in front of them, and white space at
its end. One pass over the text's bytes, a block at a time, counts the units; on the
way it records the byte and the code-point offset after every STEP-th one. A cut
behind so many units is then found by binary search over these checkpoints and a
rescan of fewer than STEP units, so a text is never held as a list of its units and
no cut reads it again from the start. Both cuts and the choice of form come from a
hash of the document's id, so reruns agree.

Defined results: a null text is empty; an empty text, and one that holds a marker,
stays plain; a text of white space alone is one unit; a null id hashes as an empty
one; repeated rows get equal results; an empty table gives an empty result; rows keep
their other columns, of any name, and one named as the result is replaced. A text is
bounded by what a row may hold; memory beyond it is a block and the checkpoints.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.arrow import small_batches

#: Units between two checkpoints, and bytes that are counted at once.
STEP, BLOCK = 64, 1 << 16
#: Markers in front of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents how many are transformed, and of 100 of those how many have the suffix first.
SHARE, SUFFIX_FIRST = 50, 80
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
FOUND = T.StructType().add("units", "long").add("output", "string").add("prefix_chars", "long").add("middle_chars", "long")


class Checkpoints:
    """The units of a UTF-8 text, and the offsets after every `step`-th one.

    `units` is their number; `cut(k)` gives the byte and the code-point offset after k.
    """

    def __init__(self, data: bytes, step: int = STEP, block: int = BLOCK):
        raw = np.frombuffer(data, np.uint8)
        self.data, self.units = data, 0
        self.at_unit, self.at_byte, self.at_point = [0], [0], [0]
        points = 0
        for begin in range(0, len(raw), block):
            part = raw[begin:begin + block]
            white = _WHITE[part]
            after = np.empty(len(part), bool)
            after[:-1] = white[1:]
            after[-1] = begin + block >= len(raw) or _WHITE[raw[begin + block]]
            ends = np.flatnonzero(after & ~white) + 1
            starts_point = (part & 0xC0) != 0x80
            marked = ends[(step - 1 - self.units) % step::step]
            if len(marked):
                upto = np.cumsum(starts_point)
                first = self.units + (step - 1 - self.units) % step + 1
                self.at_unit += range(first, first + step * len(marked), step)
                self.at_byte += (marked + begin).tolist()
                self.at_point += (upto[marked - 1] + points).tolist()
            self.units += len(ends)
            points += int(np.count_nonzero(starts_point))
        if len(raw) and _WHITE[raw[-1]]:
            self.units += 1

    def cut(self, units: int) -> tuple[int, int]:
        k = bisect_right(self.at_unit, units) - 1
        begin = at = self.at_byte[k]
        for _ in range(units - self.at_unit[k]):
            at = UNIT.match(self.data, at).end()
        return at, self.at_point[k] + len(self.data[begin:at].decode())


def transformed(data: bytes, form: str, first: int, second: int) -> tuple[int, str, int | None, int | None]:
    """Units, output, and code points of prefix and middle; cut after the lesser and the greater of two draws."""
    index = Checkpoints(data)
    if form == "plain":
        return index.units, data.decode(), None, None
    low, high = sorted((first % (index.units + 1), second % (index.units + 1)))
    (a, a_point), (b, b_point) = index.cut(low), index.cut(high)
    prefix, middle, suffix = data[:a].decode(), data[a:b].decode(), data[b:].decode()
    parts = (PREFIX, prefix, SUFFIX, suffix) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix)
    return index.units, "".join((*parts, MIDDLE, middle)), a_point, b_point - a_point


@F.arrow_udf(FOUND)
def _transform(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, forms, firsts, seconds in batches:
        rows = [transformed(t.as_py(), f.as_py(), a.as_py(), b.as_py()) for t, f, a, b in zip(texts.cast(pa.binary()), forms, firsts, seconds, strict=True)]
        units, outputs, prefixes, middles = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.StructArray.from_arrays(
            [pa.array(units, pa.int64()), pa.array(outputs, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64())],
            ["units", "output", "prefix_chars", "middle_chars"])


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four whole numbers of 32 bits, from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "fim",
                   seed: int = 42, share: int = SHARE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The rows of `docs` with `out_col`: form (plain, psm, spm), units, output, prefix_chars, middle_chars.

    `share` of 100 documents are transformed, `suffix_first` of 100 of those have the
    suffix in front (spm). Numbers of code points are null for plain texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first, second, third, fourth = _draws(id_col, seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (third % 100 >= share), "plain").when(fourth % 100 < suffix_first, "spm").otherwise("psm")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out_col]
    rows = small_batches(docs).select(F.struct(*kept).alias("row"), F.struct(text.alias("text"), form.alias("form"), first.alias("a"), second.alias("b")).alias("do"))
    done = rows.select("row", F.col("do.form").alias("form"), _transform.asNondeterministic()("do.text", "do.form", "do.a", "do.b").alias("found"))
    return done.select("row.*", F.struct("form", "found.units", "found.output", "found.prefix_chars", "found.middle_chars").alias(out_col))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from output and form.

    No part holds a marker, and none can begin within a marker, so the first one found stands where it was put.
    """
    size = len(PREFIX)
    middle_at = F.locate(MIDDLE, output, size + 1)
    middle = F.substr(output, middle_at + size)
    between_at = F.when(form == "psm", F.locate(SUFFIX, output, size + 1)).otherwise(F.locate(PREFIX, output, size + 1))
    one = F.substr(output, F.lit(size + 1), between_at - size - 1)
    two = F.substr(output, between_at + size, middle_at - between_at - size)
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)


def op12_fill_in_middle(docs: DataFrame) -> DataFrame:
    """One row for each document: units, form, cuts, and hashes of the output and of the text rebuilt from it."""
    found = fill_in_middle(docs.select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", F.col("fim.units").alias("n"), "fim.form", "fim.prefix_chars", "fim.middle_chars",
        digest(F.col("fim.output")).alias("output_sha256"), digest(restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, x, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
f AS (SELECT doc_id, x, w, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, x, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256 FROM p
"""
