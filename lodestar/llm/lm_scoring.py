"""Language-model scoring by Brown class bigrams.

Words are put into classes by exchange, and a text's probability is the product of
class transitions and of word emissions within classes; a text ends with an end
token, which is a class of its own. The parts, each a pass of tasks over the texts:

1. Deal texts to buckets. A bucket is one row: its different words, once each, and its
   texts as numbers of these. Texts are neither read nor cut into words again.
2. Count words: each bucket sends its words, with their counts, to PARTS parts by hash.
   The EXCHANGED most frequent words are exchanged. Their bigrams, counted, are packed
   into one row for each block of words. In each round every other block exchanges its
   words one after the other, against the class pairs that the round began with; rounds
   end when the likelihood no longer grows, and the best classes seen are kept.
3. Every other word, however rare, joins the class that gains most from the classes of
   the exchanged words around it: one exchange of each. Buckets send words and the
   classes around them to the parts, which answer each bucket with the count and class
   of its words, in the order they came in and without the words.
4. Answers meet their buckets, whose texts become sequences of classes and, for each text,
   sums of emissions. No table of words is broadcast.
5. Class pairs are counted over the training texts' sequences; each text is scored.

Whole numbers travel packed (`arrow.packed`), many to a row, not as a row each: the
texts of large tables have millions of different words, most of them in few texts.

Emissions take an absolute discount from each count and keep it for unknown words,
which may be of any class: the sum over their classes is exact. Class transitions are
pulled towards class frequencies. Counts, classes and transitions come from all
training texts. Only tables of fixed size reach the driver or are broadcast: EXCHANGED
words and classes, class pairs, and sums by class of each part.

Defined results: a null text is empty and scores as an end alone; without training
texts a word is unknown and transitions are even; repeated rows train again and get
equal results; an empty table gives an empty result; columns other than id, text and
the training mark are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import brown_classes
from lodestar.llm.arrow import packed, small_batches, unpacked
from lodestar.llm.scratch import free, freed_shuffles, scope, written

#: Classes beside the end's, words that rounds of exchange take, words of a block, and rounds at most.
CLASSES, EXCHANGED, BLOCK, ROUNDS = 64, 1 << 14, 64, 8
#: Bytes of text of a bucket, and of a run of texts that are worked on at once.
BUCKET_BYTES, RUN_BYTES = 16 << 20, 1 << 20
#: Words of a row of words at most, and a measure of the tokens that a task holds before it counts them.
ROW_WORDS, TALLY = 2000, 400_000
#: Parts that words are dealt to by hash, and bigrams.
PARTS, PAIR_PARTS = 1024, 512
#: The end of a text, as a token; no word is empty. It is the first word of each bucket.
END = b""
#: Bytes that words are made of, and A-Z in lower case.
IN_WORDS = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_ROWS = "part int, bucket long, first int, words binary, lengths binary, n binary, contexts binary"


def _tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words with A-Z in lower case of texts on end, an END behind each text; and how many tokens each text has."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = IN_WORDS[data]
    steps = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(steps > 0), np.flatnonzero(steps < 0)
    words_before = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts]))
    lengths = np.insert(ends - begins, words_before, 0)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]])])
    return tokens, np.diff(words_before, prepend=0) + 1


def _unjoined(data: bytes, lengths: np.ndarray) -> pa.Array:
    """Words of their joined bytes and lengths."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Joined bytes of words that begin their buffers, and where each begins and the last ends."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[:len(words) + 1]
    return np.frombuffer(data or b"", np.uint8)[:at[-1]], at


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows, with their texts."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        begin = held = 0
        for i, text in enumerate(texts, 1):
            held += len(text) + 64
            if held >= RUN_BYTES or i == len(texts):
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, held = i, 0


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, training, text) to buckets, runs of rows of a partition."""
    bucket = TaskContext.get().partitionId() << 32
    held, ids, training, sizes, words, codes = 0, [], [], [], [], []

    def row() -> pa.RecordBatch:
        all_ids = pa.concat_arrays(ids)
        kinds = pa.concat_arrays([pa.array([END], pa.binary()), *words]).dictionary_encode()
        number = kinds.indices.to_numpy()
        begins = np.cumsum([1, *map(len, words)])
        numbers = np.concatenate([number[b + c] for b, c in zip(begins, codes, strict=False)])
        data, offsets = _bytes_of(kinds.dictionary)
        parts = [zlib.crc32(w) % PARTS for w in kinds.dictionary.to_pylist()]
        return pa.RecordBatch.from_arrays([
            pa.array([bucket], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids), *[pa.array([v], pa.binary()) for v in (
                packed(np.concatenate(training), 1), packed(np.concatenate(sizes)), packed(data, 1), packed(np.diff(offsets)), packed(numbers), packed(parts, 2))]], BUCKET_COLUMNS)

    for run, texts in _runs(batches):
        tokens, n = _tokens(texts)
        kinds = tokens.dictionary_encode()
        ids.append(run.column("id"))
        training.append(run.column("training").to_numpy(zero_copy_only=False))
        sizes.append(n)
        words.append(kinds.dictionary)
        codes.append(kinds.indices.to_numpy())
        held += sum(map(len, texts)) + 64 * len(texts)
        if held >= BUCKET_BYTES:
            yield row()
            held, bucket = 0, bucket + 1
            for column in (ids, training, sizes, words, codes):
                column.clear()
    if ids:
        yield row()


BUCKET_COLUMNS = ["bucket", "ids", "training", "sizes", "words", "lengths", "codes", "parts"]


def dealt(rows: DataFrame) -> DataFrame:
    """Buckets of rows (id, training, text), written."""
    kind = rows.schema["id"].dataType.simpleString()
    return written(small_batches(rows).mapInArrow(_deal, f"bucket long, ids array<{kind}>, {', '.join(f'{c} binary' for c in BUCKET_COLUMNS[2:])}"), "lm-buckets")


@dataclass
class Bucket:
    """A bucket's different words and their parts, and its training texts, on end, as numbers of words."""

    number: int
    words: pa.Array
    parts: np.ndarray
    learned: np.ndarray

    COLUMNS = ("bucket", "words", "lengths", "parts", "codes", "sizes", "training")

    @classmethod
    def each(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
        for batch in batches:
            for row in range(len(batch)):
                number, words, *numbers = (batch.column(c)[row].as_py() for c in cls.COLUMNS)
                lengths, parts, codes, sizes, training = (unpacked(v, w) for v, w in zip(numbers, (4, 2, 4, 4, 1), strict=True))
                yield cls(number, _unjoined(unpacked(words, 1).tobytes(), lengths), parts, codes[np.repeat(training > 0, sizes)])


def _places(words: pa.Array, of: pa.Array) -> np.ndarray:
    """Where each word is in `of`, or -1."""
    return pc.fill_null(pc.index_in(words, of), -1).to_numpy().astype(np.int64)


def _cuts(sorted_keys: np.ndarray, most: int | None = None) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys, or of at most `most` of them."""
    bounds = [0, *(np.flatnonzero(np.diff(sorted_keys)) + 1).tolist(), len(sorted_keys)]
    return [(b, min(b + (most or e), e)) for a, e in zip(bounds, bounds[1:]) for b in range(a, e, most or max(1, e - a))]


def _word_rows(bucket: Bucket, n: np.ndarray, keep: np.ndarray, contexts: tuple[np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """The words of a bucket that are kept, by part, with n of each. `first` counts them in this order.

    contexts: of each occurrence of some words, the word's number and a value.
    """
    order = np.argsort(bucket.parts.astype(np.uint16), kind="stable")
    order = order[keep[order]]
    data, at = _bytes_of(bucket.words.take(pa.array(order)))
    parts, n, lengths = bucket.parts[order], n[order], np.diff(at)
    values, value_at = np.zeros(0, np.uint16), np.zeros(len(order) + 1, np.int64)
    if contexts:
        place = np.zeros(len(bucket.words), np.int64)
        place[order] = np.arange(len(order))
        which = place[contexts[0]]
        values = contexts[1][np.argsort(which, kind="stable")]
        value_at = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(order)))))
    rows = [(parts[b], bucket.number, b, packed(data[at[b]:at[e]], 1), packed(lengths[b:e]), packed(n[b:e]), packed(values[value_at[b]:value_at[e]], 2)) for b, e in _cuts(parts, ROW_WORDS)]
    kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return _batch(["part", "bucket", "first", "words", "lengths", "n", "contexts"], *zip(columns, kinds, strict=True))


@dataclass
class WordsOfPart:
    """The rows of words of a part: different words, and of all rows' words on end which they are, how many each row has, and n."""

    words: pa.Array
    which: np.ndarray
    sizes: list[int]
    n: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> WordsOfPart:
        lengths = [unpacked(v) for v in table.column("lengths").to_pylist()]
        data = b"".join(unpacked(v, 1).tobytes() for v in table.column("words").to_pylist())
        kinds = _unjoined(data, np.concatenate(lengths)).dictionary_encode()
        return cls(kinds.dictionary, kinds.indices.to_numpy(), list(map(len, lengths)), np.concatenate([unpacked(v) for v in table.column("n").to_pylist()]))

    def totals(self) -> np.ndarray:
        return np.bincount(self.which, self.n, len(self.words)).astype(np.int64)  # counts under 2**53 are exact as weights


def _words_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket in Bucket.each(batches):
        n = np.bincount(bucket.learned, minlength=len(bucket.words))
        yield _word_rows(bucket, n, n > 0)


def _summed(table: pa.Table) -> pa.Table:
    found = WordsOfPart.of(table)
    return pa.table({"word": found.words, "n": found.totals()})


def word_counts(buckets: DataFrame) -> DataFrame:
    """Rows (word, n) of the training texts' tokens."""
    sent = buckets.select(*Bucket.COLUMNS).mapInArrow(_words_counted, WORD_ROWS)
    return sent.groupBy("part").applyInArrow(_summed, "word binary, n long")


def _cells(parts: np.ndarray, codes: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Of each run of equal parts: the part, its codes, which grow, and their n."""
    return [(parts[b], packed(np.diff(codes[b:e], prepend=0)), packed(n[b:e], 8)) for b, e in _cuts(parts)]


def _uncelled(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.cumsum(unpacked(v)) for v in table.column("codes").to_pylist()], [unpacked(v, 8) for v in table.column("n").to_pylist()]


def _count_pairs(shared):
    """Bigrams of words that are exchanged, dealt to parts: first * width + second = code * PAIR_PARTS + part."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        width, held, size = len(frequent), [], 0

        def rows() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            order = np.argsort((codes % PAIR_PARTS).astype(np.uint16), kind="stable")
            codes = codes[order]
            cells = list(zip(*_cells(codes % PAIR_PARTS, codes // PAIR_PARTS, n[order]), strict=True)) or [()] * 3
            return _batch(["part", "codes", "n"], *zip(cells, (pa.int32(), pa.binary(), pa.binary()), strict=True))

        for bucket in Bucket.each(batches):
            at = _places(bucket.words, frequent)[bucket.learned]
            came = np.concatenate(([0], at[:-1]))[:len(at)]  # the end of the text before is what a text begins behind
            both = (at >= 0) & (came >= 0)
            held.append(came[both] * width + at[both])
            size += len(held[-1])
            if size >= 8 * TALLY:
                yield rows()
                size = 0
        yield rows()

    return count


def _sum_pairs(width: int):
    """Bigrams of a part, summed up, to the blocks of both of their words: own word in its block * width + other word = code."""
    def add(table: pa.Table) -> pa.Table:
        codes, n = map(np.concatenate, _uncelled(table))
        codes, which = np.unique(codes, return_inverse=True)
        n = np.bincount(which, n, len(codes)).astype(np.int64)
        first, second = np.divmod(codes * PAIR_PARTS + table.column("part")[0].as_py(), width)
        rows = []
        for own, other, is_first in ((first, second, 1), (second, first, 0)):
            order = np.lexsort((other, own))
            own, other = own[order], other[order]
            rows += [(block, is_first, *cell) for block, *cell in _cells(own // BLOCK, own % BLOCK * width + other, n[order])]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int8(), pa.binary(), pa.binary()), strict=True)], ["block", "first", "codes", "n"])

    return add


def _pack(width: int):
    """The bigrams of one block's words as one row."""
    def pack(table: pa.Table) -> pa.Table:
        codes, n = _uncelled(table)
        first = np.repeat(table.column("first").to_numpy(), list(map(len, codes)))
        codes, n, block = np.concatenate(codes), np.concatenate(n), table.column("block")[0].as_py()
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        columns = (packed(codes // width + block * BLOCK), packed(codes % width), packed(first[order], 1), packed(n[order], 8))
        return pa.table([pa.array([block], pa.int32()), *[pa.array([v], pa.binary()) for v in columns]], ["block", "own", "other", "first", "n"])

    return pack


def _unpack(batch: pa.RecordBatch, i: int):
    own, other, first, n = (unpacked(batch.column(k + 1)[i].as_py(), w) for k, w in enumerate((4, 4, 1, 8)))
    return batch.column(0)[i].as_py(), own, other, first.astype(bool), n


def _pair_counts(classes: np.ndarray, k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for i in range(len(batch)):
                _, own, other, first, n = _unpack(batch, i)
                # counts under 2**53 are exact as weights
                total += np.bincount(classes[own[first]] * k + classes[other[first]], n[first], k * k).astype(np.int64)
        at = np.flatnonzero(total)
        yield _batch(["code", "n"], (at, pa.int32()), (total[at], pa.int64()))

    return count


def _exchange(classes: np.ndarray, pairs: np.ndarray, odd: int, n_words: int):
    def exchange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block, own, other, first, n = _unpack(batch, i)
                if block % 2 == odd:
                    words = np.arange(block * BLOCK, min(n_words, (block + 1) * BLOCK))
                    yield _batch(["word", "class"], (words, pa.int32()), (brown_classes.exchanged(pairs, classes, words, own - words[0], other, first, n), pa.int32()))

    return exchange


def _matrix(counts: DataFrame, k: int) -> np.ndarray:
    """Class pairs, of which there are at most k * k."""
    total = np.zeros(k * k)
    for row in counts.groupBy("code").agg(F.sum("n").alias("n")).collect():
        total[row["code"]] = row["n"]
    return total.reshape(k, k)


def exchange_classes(buckets: DataFrame, words: list[bytes], n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each of `words`, most frequent first behind the end, and the class pairs among them.

    Words start in classes by rank, in turn.
    """
    n, k = len(words), n_classes + 1
    shared = buckets.sparkSession.sparkContext.broadcast(pa.array(words, pa.binary()))
    cells = buckets.select(*Bucket.COLUMNS).mapInArrow(_count_pairs(shared), "part int, codes binary, n binary")
    sides = cells.groupBy("part").applyInArrow(_sum_pairs(n), "block int, first byte, codes binary, n binary")
    blocks = written(sides.groupBy("block").applyInArrow(_pack(n), "block int, own binary, other binary, first binary, n binary"), "word-blocks")
    classes = np.concatenate(([0], 1 + np.arange(n - 1) % n_classes))
    counted = lambda: _matrix(blocks.mapInArrow(_pair_counts(classes, k), "code int, n long"), k)
    now = counted()
    best = (brown_classes.likelihood(now), classes, now)
    still = 0
    for r in range(rounds if n > 1 else 0):
        found = blocks.mapInArrow(_exchange(classes, now, r % 2, n), "word int, class int").collect()  # EXCHANGED rows at most
        classes = classes.copy()
        for row in found:
            classes[row["word"]] = row["class"]
        now = counted()
        likelihood = brown_classes.likelihood(now)
        still = 0 if likelihood > best[0] + 1e-4 * abs(best[0]) else still + 1
        if likelihood > best[0]:
            best = (likelihood, classes, now)
        if still >= 2:  # neither half of the blocks gains
            break
    return best[1], best[2]


@dataclass
class Exchanged:
    """The words that were exchanged, the end first, with their counts and classes, and the class pairs among them."""

    words: pa.Array
    n: np.ndarray
    classes: np.ndarray
    pairs: np.ndarray

    def __post_init__(self):
        # classes of words that occur once, by the classes around them
        self.width = len(self.pairs) + 1
        self.once = self.joined(np.arange(self.width ** 2), np.ones(self.width ** 2, np.int64))

    def joined(self, contexts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The classes that words join; contexts: of each of `sizes` occurrences of each, (class before) * width + (class after)."""
        joiner, width, none = brown_classes.Joiner(self.pairs), self.width, self.width - 1
        ends, found = np.concatenate(([0], np.cumsum(sizes))), []
        for b in range(0, len(sizes), 4 * BLOCK):
            e = min(b + 4 * BLOCK, len(sizes))
            codes, word = contexts[ends[b]:ends[e]], np.repeat(np.arange(e - b), sizes[b:e])
            after, before = (np.bincount(word * width + c, minlength=(e - b) * width).reshape(-1, width)[:, :none].astype(float) for c in (codes % width, codes // width))
            found.append(joiner.of(after, before))
        return np.concatenate([np.zeros(0, np.int64), *found])


def exchanged_words(buckets: DataFrame, counts: DataFrame, n_classes: int, n_exchanged: int, rounds: int) -> Exchanged:
    """counts: rows (word, n) of all tokens of the training texts of `buckets`, words as bytes."""
    is_end, level = F.col("word") == F.lit(END), F.floor(F.log2("n") * 32)
    # only words of levels of n that the most frequent ones reach are sorted, or each task would send the driver as many as all
    least = reached = 0
    for row in sorted(counts.where(~is_end).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        if reached < n_exchanged:
            least, reached = row["level"], reached + row["words"]
    top = counts.where(is_end | (level >= least)).orderBy(F.desc(is_end), F.desc("n"), "word").limit(n_exchanged + 1).collect()
    ends = sum(r["n"] for r in top if bytes(r["word"]) == END)
    top = [(bytes(r["word"]), r["n"]) for r in top if bytes(r["word"]) != END][:n_exchanged]
    words = [END, *[w for w, _ in top]]
    with scope():
        classes, pairs = exchange_classes(buckets, words, n_classes, rounds)
    return Exchanged(pa.array(words, pa.binary()), np.array([ends, *[n for _, n in top]], np.int64), classes, pairs)


def _contexts(shared):
    """All words of buckets, and the classes around those outside of the exchange."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exchanged = shared.value
        of = np.append(exchanged.classes, exchanged.width - 1)  # -1: no class
        for bucket in Bucket.each(batches):
            at = _places(bucket.words, exchanged.words)[bucket.learned]
            came = np.concatenate(([0], at[:-1]))[:len(at)]
            rare = np.flatnonzero(at < 0)  # none is the last, which is an end
            values = of[came[rare]] * exchanged.width + of[at[rare + 1]]
            n = np.bincount(bucket.learned[rare], minlength=len(bucket.words))
            yield _word_rows(bucket, n, np.ones(len(n), bool), (bucket.learned[rare], values.astype(np.uint16)))

    return find


def _join(exchanged: Exchanged, table: pa.Table) -> tuple[WordsOfPart, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a part with n and class of each; and which of them were exchanged."""
    found = WordsOfPart.of(table)
    n, place = found.totals(), _places(found.words, exchanged.words)
    classes = np.full(len(n), brown_classes.UNSEEN, np.int64)
    contexts = np.concatenate([unpacked(v, 2) for v in table.column("contexts").to_pylist()])
    word = np.repeat(found.which, found.n)
    contexts = contexts[np.argsort(word, kind="stable")]
    of_word = np.repeat(n, n)
    classes[n == 1] = exchanged.once[contexts[of_word == 1]]
    classes[n > 1] = exchanged.joined(contexts[of_word > 1], n[n > 1])
    known = place >= 0
    n[known], classes[known] = exchanged.n[place[known]], exchanged.classes[place[known]]
    return found, n, classes, known


def _joined_words(shared):
    def join(table: pa.Table) -> pa.Table:
        found, n, classes, known = _join(shared.value, table)
        of = pa.table([found.words, pa.array(n), pa.array(classes, pa.int32())], ["word", "n", "class"])
        return of.filter(pa.array((n > 0) & ~known))

    return join


def _answers(shared):
    """n and class of the words of each row, for its bucket; and a row without bucket of sums by class of words outside of the exchange."""
    def answer(table: pa.Table) -> pa.Table:
        found, n, classes, known = _join(shared.value, table)
        ends = np.cumsum(found.sizes)
        rows = [(b, f, packed(n[w], 8), packed(classes[w], 1)) for b, f, w in zip(
            table.column("bucket").to_pylist(), table.column("first").to_pylist(), np.split(found.which, ends[:-1]), strict=True)]
        new, k = (n > 0) & ~known, len(shared.value.pairs)
        n, classes = n[new], classes[new]
        sums = np.concatenate((np.bincount(classes, n, k), np.bincount(classes, minlength=k), [np.sum(n == 1), np.sum(n == 2)]))
        rows.append((None, None, packed(sums, 8), None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["of_bucket", "first", "n", "class"])

    return answer


def word_classes(texts: DataFrame, counts: DataFrame, n_classes: int = CLASSES, n_exchanged: int = EXCHANGED, rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """Rows (word, n, class) of the words that are not exchanged, and {word: (n, class)} of those that are, the end among them.

    texts: one column of texts; counts: word, n of all their tokens.
    """
    with scope() as keep:
        buckets = dealt(texts.select(F.lit(0).alias("id"), F.lit(True).alias("training"), F.col(texts.columns[0]).alias("text")))
        exchanged = exchanged_words(buckets, counts.select(F.col("word").cast("binary").alias("word"), "n"), n_classes, n_exchanged, rounds)
        shared = texts.sparkSession.sparkContext.broadcast(exchanged)
        sent = buckets.select(*Bucket.COLUMNS).mapInArrow(_contexts(shared), WORD_ROWS)
        others = sent.groupBy("part").applyInArrow(_joined_words(shared), "word binary, n long, class int")
        others = keep(written(others.select(F.col("word").cast("string").alias("word"), "n", "class"), "word-classes"))
    return others, {w.decode(): (n, k) for w, n, k in zip(exchanged.words.to_pylist(), exchanged.n.tolist(), exchanged.classes.tolist(), strict=True)}


def _encode(model: brown_classes.ClassBigrams, n_tokens: int, n_types: int):
    """A bucket, with the answers on its words, to sequences of classes, and sums of each text."""
    def base(n):
        return np.log10((n + 0.1) / (n_tokens + 0.1 * (n_types + 1)))

    def encode(buckets: pa.Table, answers: pa.Table) -> pa.Table:
        codes, parts, sizes = (unpacked(buckets.column(c)[0].as_py(), w) for c, w in (("codes", 4), ("parts", 2), ("sizes", 4)))
        order = np.argsort(parts.astype(np.uint16), kind="stable")  # words came in this order to the parts
        n, k = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.uint8)
        for first, of_n, of_k in zip(*[answers.column(c).to_pylist() for c in ("first", "n", "class")], strict=True):
            of_k = unpacked(of_k, 1)
            at = order[first:first + len(of_k)]
            n[at], k[at] = unpacked(of_n, 8), of_k
        seen = np.flatnonzero(n > 0)
        emission = np.zeros(len(n))
        emission[seen] = model.emission(n[seen].astype(float), k[seen].astype(np.int64))
        starts = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(of[codes], starts, dtype=kind).astype(kind) for of, kind in ((n > 0, np.int64), (base(n), float), (emission, float))]
        return pa.table([buckets.column("ids"), buckets.column("training"), buckets.column("sizes"), *[pa.array([v], pa.binary()) for v in (
            *[x.tobytes() for x in sums], packed(k[codes], 1))]], ["ids", "training", "sizes", "n_known", "base_score", "emitted", "classes"])

    return encode


def _sequence_pairs(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for training, sizes, classes in zip(*[batch.column(c).to_pylist() for c in ("training", "sizes", "classes")], strict=True):
                to = unpacked(classes, 1)[np.repeat(unpacked(training, 1) > 0, unpacked(sizes))].astype(np.int64)
                total += np.bincount(np.concatenate(([0], to[:-1]))[:len(to)] * k + to, minlength=k * k)
        at = np.flatnonzero(total)
        yield _batch(["code", "n"], (at, pa.int32()), (total[at], pa.int64()))

    return count


def _score(model: brown_classes.ClassBigrams, id_col: str, n_tokens: int):
    """A row for each text of a bucket."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                training, sizes, classes = (unpacked(batch.column(c)[i].as_py(), w) for c, w in (("training", 1), ("sizes", 4), ("classes", 1)))
                known, base, emitted = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("n_known", np.int64), ("base_score", float), ("emitted", float)))
                ends = np.cumsum(sizes)
                path = np.array([model.path(classes[e - size:e]) for e, size in zip(ends.tolist(), sizes.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, *map(pa.array, (training > 0, sizes, known, np.full(len(sizes), n_tokens), base, emitted + path))],
                    [id_col, "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
                n_classes: int = CLASSES, n_exchanged: int = EXCHANGED, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of `docs`: id, training, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where `training` holds and scores all of them. Both
    scores are logarithms to base 10: base_score of the words' own smoothed
    frequencies, score of the model. 10 ** (-score / n_tokens) is a text's perplexity.
    """
    spark = docs.sparkSession
    with scope() as keep, freed_shuffles(spark):
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(training, F.lit(False)).alias("training"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        kind = rows.schema["id"].dataType.simpleString()
        buckets = dealt(rows)
        exchanged = exchanged_words(buckets, written(word_counts(buckets), "word-counts", "zstd"), n_classes, n_exchanged, rounds)
        free(spark)
        shared = spark.sparkContext.broadcast(exchanged)
        sent = buckets.select(*Bucket.COLUMNS).mapInArrow(_contexts(shared), WORD_ROWS)
        answers = written(sent.groupBy("part").applyInArrow(_answers(shared), "of_bucket long, first int, n binary, class binary"), "word-classes")
        k = n_classes + 1
        sums = np.zeros(2 * k + 2)
        for row in answers.where("of_bucket IS NULL").select("n").collect():  # PARTS rows at most
            sums += unpacked(bytes(row["n"]), 8)
        totals = sums[:k] + np.bincount(exchanged.classes, exchanged.n, k)
        kinds = sums[k:2 * k] + np.bincount(exchanged.classes[exchanged.n > 0], minlength=k)
        once, twice = (int(of + np.sum(exchanged.n[1:] == x)) for x, of in zip((1, 2), sums[2 * k:], strict=True))
        discount = brown_classes.discount_of(once, twice)
        n_tokens, n_types = int(totals.sum()), int(kinds.sum())
        emitting = brown_classes.ClassBigrams(np.zeros((k, k)), totals, kinds, discount)
        of_bucket = answers.where("of_bucket IS NOT NULL").groupBy("of_bucket")
        encoded = buckets.select("bucket", "ids", "training", "sizes", "codes", "parts").groupBy("bucket").cogroup(of_bucket).applyInArrow(
            _encode(emitting, n_tokens, n_types), f"ids array<{kind}>, training binary, sizes binary, n_known binary, base_score binary, emitted binary, classes binary")
        encoded = written(encoded, "lm-classes")
        pairs = _matrix(encoded.select("training", "sizes", "classes").mapInArrow(_sequence_pairs(k), "code int, n long"), k)
        model = brown_classes.ClassBigrams(pairs, totals, kinds, discount)
        scored = encoded.mapInArrow(_score(model, id_col, n_tokens), f"`{id_col}` {kind}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        return keep(written(scored, "lm-scores"))


def op11_lm_scoring(docs: DataFrame) -> DataFrame:
    """One row for each document: its tokens, and its logarithmic probability by word frequencies and by the model."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    scored = score_texts(docs.select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
