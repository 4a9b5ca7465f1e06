"""Spelling variants by a self-join of a vocabulary trie with active-node sets.

Words are the letter runs of all texts, counted. Two words are near if one inserted,
deleted or replaced code point makes one of the other. The trie of the vocabulary is
partitioned by prefix: a task walks the tries of the prefixes dealt to it from the
root, and hands each node the nodes at distance one from it, its active nodes: its
parent, its siblings, its children, and the children by the same letter of its
parent's active nodes. A word's node meets its near words among them.

Words that differ within the prefix have active nodes in other partitions. Below the
prefix the distance is used up, so what follows must be equal: such words meet in
groups of equal rest, one group for words of equal length and one for a word and those
that are longer by one, and the same walk over a group's trie finds them. A group
holds no more words than there are beginnings of BAND letters. A prefix that more than
MOST_WORDS words share is cut further: the letters behind the words' longest common
prefix become one more such band, and the partition goes on below it. So every pair
meets once, in the band or partition that holds the end of its common prefix, and no
task gathers more than a bounded part of a prefix, however many words share it.

Defined results: a null text has no words; a null id counts as an empty one; rows that
repeat a document count again; an empty table gives an empty result; columns other
than id and text are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.arrow import small_batches
from lodestar.llm.scratch import scope, written

#: Shortest words, least occurrences, and how often as often the form of a word occurs.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: Letters of the first prefix, and of the bands that a prefix with more words than MOST_WORDS is cut by.
FIRST_PREFIX, BAND, MOST_WORDS = 3, 2, 20_000
#: One in so many runs loses a letter, which makes misspelt words to find.
SLIPS = 31
#: Distinct words that a task counts before it hands them on.
TALLY_WORDS = 200_000
LETTERS = r"a-zÀ-ÿ"


def _tally(slips: int, least: int):
    run = re.compile(f"[{LETTERS}]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return made

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                start = zlib.crc32(f"{key.as_py()}:".encode())
                # of bytes, lower() knows A-Z alone
                for word, n in Counter(run.findall(text.as_py().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if slips and h % slips == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    found[word] += n
                if len(found) >= TALLY_WORDS:
                    yield rows()
        yield rows()

    return count


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = 0,
               least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n): maximal runs of letters with A-Z in lower case, and their occurrences.

    With `slips`, a run whose CRC-32 with its document's id divides by it loses one letter.
    """
    texts = small_batches(docs).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.mapInArrow(_tally(slips, least_letters), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where((F.length("word") >= least_letters) & (F.col("n") >= least_count))


def near_in_trie(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places (i, j), i < j, of different words at distance one, by a walk of their trie with active nodes."""
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, word in enumerate(words):
        node = 0
        for letter in word:
            down = children[node].get(letter)
            if down is None:
                down = children[node][letter] = len(children)
                children.append({})
                ends.append(-1)
            node = down
        ends[node] = i
    walk = [(0, set(children[0].values()))]
    while walk:
        node, active = walk.pop()
        below = children[node]
        for letter, down in below.items():
            near = {node, *below.values(), *children[down].values()}
            near.discard(down)
            for other in active:
                same = children[other].get(letter)
                if same is not None:
                    near.add(same)
            i = ends[down]
            if i >= 0:
                for other in near:
                    if ends[other] > i:
                        yield i, ends[other]
            if children[down]:
                walk.append((down, near))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each run of rows with an equal key."""
    out: list[list] = [[], [], [], []]
    held: dict[str, tuple[int, set[bool]]] = {}  # a word that ends within the band has one rest for both its parts
    key = lo = hi = None

    def close() -> None:
        if len(held) > 1:
            words = list(held)
            for i, j in near_in_trie(words):
                a, b = sorted((words[i], words[j]), key=lambda w: (len(w), w))
                (n_a, parts_a), (n_b, parts_b) = held[a], held[b]
                meant = (len(a) < len(b)) in parts_a and False in parts_b
                if hi < 0 or meant and lo <= len(commonprefix((a, b))) < hi:
                    for column, value in zip(out, (a, n_a, b, n_b), strict=True):
                        column.append(value)
        held.clear()

    def rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64()) * 2, strict=True)], ["a", "n_a", "b", "n_b"])
        for column in out:
            column.clear()
        return made

    for batch in batches:
        for group, word, n, short, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != key:
                close()
                key, lo, hi = group, begin, end
            held.setdefault(word, (n, set()))[1].add(short)
        if len(out[0]) >= TALLY_WORDS:
            yield rows()
    close()
    yield rows()


@F.arrow_udf(T.IntegerType())
def _common(first: pa.Array, last: pa.Array) -> pa.Array:
    """Length of the longest common prefix."""
    return pa.array([len(commonprefix((a.as_py(), b.as_py()))) for a, b in zip(first, last, strict=True)], pa.int32())


def _rows(words: DataFrame, lo: Column, hi: Column, short: bool) -> DataFrame:
    """Words under the key of their group: a prefix, and what follows the band from lo to hi where there is one."""
    rest = F.when(hi < 0, "").otherwise(F.substr("word", hi + (0 if short else 1)))
    key = F.concat_ws("/", lo, hi, F.substr("word", F.lit(1), lo), rest)
    return words.select(key.alias("key"), "word", "n", F.lit(short).alias("short"), lo.alias("lo"), hi.alias("hi"))


def near_pairs(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """Rows (a, n_a, b, n_b): each pair of words at distance one, once. words: word, n, no word twice, all longer than FIRST_PREFIX."""
    band = lambda rows, lo, hi: _rows(rows, lo, hi, False).union(_rows(rows, lo, hi, True))
    meet = band(words, F.lit(0), F.lit(FIRST_PREFIX))
    left = words.withColumn("depth", F.lit(FIRST_PREFIX))
    head = F.substr("word", F.lit(1), F.col("depth")).alias("head")
    while True:
        sizes = left.groupBy("depth", head).agg(F.count(F.lit(1)).alias("n_words"), F.min("word").alias("first"), F.max("word").alias("last"))
        hot = written(sizes.where(F.col("n_words") > most_words).select("depth", "head", _common("first", "last").alias("common")), "hot-prefixes")
        if hot.isEmpty():
            break
        left = left.withColumn("head", head).join(hot, ["depth", "head"], "left")
        left = written(left.select("word", "n", "depth", "common"), "prefix-words")
        meet = meet.union(_rows(left.where("common IS NULL"), F.col("depth"), F.lit(-1), False))
        left = left.where("common IS NOT NULL")
        meet = meet.union(band(left, F.col("common"), F.col("common") + BAND))
        left = left.select("word", "n", (F.col("common") + BAND).alias("depth"))
    meet = meet.union(_rows(left, F.col("depth"), F.lit(-1), False))
    return meet.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root): the last word that forms lead to. forms: word, form; no word twice, and no cycle.

    Each round doubles the steps taken; a chain is no longer than counts can grow by.
    """
    led = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = led.select(F.col("word").alias("root"), F.col("root").alias("further"))
        both = led.join(on, "root", "left")
        if both.where("further IS NOT NULL").isEmpty():
            return led
        led = written(both.select("word", F.coalesce("further", "root").alias("root")), "roots")


def variants(words: DataFrame, times: int = TIMES, most_words: int = MOST_WORDS) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for each of `words` (word, n).

    A word's form is the near word of greatest n, the smallest of equal ones, if that
    is `times` the word's n or more; root is where forms lead.
    """
    pairs = written(near_pairs(words, most_words), "near-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    taken = -F.col("best.n") >= times * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n"))
    found = written(found, "variants")
    led = roots(found.where("form IS NOT NULL"))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(docs: DataFrame) -> DataFrame:
    """One row for each word of LEAST_LETTERS letters that occurs LEAST_COUNT times: its form, root, near words and counts."""
    with scope() as keep:
        words = written(vocabulary(docs, slips=SLIPS), "words")
        return keep(written(variants(words), "spelling"))


_CRC = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(encode(s))), lambda i: CAST('0x' || hex(encode(s))[2 * i + 1:2 * i + 2] AS UBIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [1::UBIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)))"""
OP13_SQL = rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
g AS (SELECT w, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s, count(*) AS k FROM r WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, k, {_CRC} AS h FROM g),
v AS (SELECT CASE WHEN h % 31 = 0 THEN w[:CAST(h % length(w) AS BIGINT)] || w[CAST(h % length(w) AS BIGINT) + 2:] ELSE w END AS word, k FROM h),
t AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM v GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2),
d AS (SELECT DISTINCT word, n, i, word[:i] || word[i + 2:] AS d FROM t, range(length(word)) q(i)),
p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.d = b.d AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT d.word, t.word, t.n FROM d JOIN t ON d.d = t.word UNION SELECT t.word, d.word, d.n FROM d JOIN t ON d.d = t.word),
b AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS rn FROM p),
f AS (SELECT t.word, t.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * t.n THEN near END AS form, CASE WHEN near_n >= 10 * t.n THEN near_n END AS form_n FROM t LEFT JOIN b ON b.word = t.word AND rn = 1),
z AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, z.root FROM f JOIN z ON f.form = z.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON f.word = z.word
"""
