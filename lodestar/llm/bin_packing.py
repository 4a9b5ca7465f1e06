"""Best-fit packing of tokenised documents by minimum bin slack.

Bins are filled one after another: among the lengths still available, the bin
that takes the longest one is filled as full as any combination can make it,
found by a bitset subset-sum dynamic programme, and the combination is removed.
Sizes are whole numbers up to the capacity, so what the search needs is the
histogram of lengths, which has at most `capacity` rows however large the corpus
is. A combination is taken as often in a row as the histogram allows, which gives
the bins that one-at-a-time removal gives while the counts last. The search
therefore does at most a few thousand programmes on the driver, for any corpus.

Placement is distributed again: pieces of a length are dealt to blocks by a hash
and ranked by prefix sums over the blocks, and each combination owns a range of
ranks of each of its lengths, so a piece's bin and offset follow from its rank by
lookup.

Defined results: a null text is empty and gives one piece, the end id alone;
repeated rows are packed as documents of their own; an empty table gives an empty
result; pieces of one length rank by (block, doc_id, piece, start), equal ones in
any order; columns other than id and text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.arrow import given_back, small_batches
from lodestar.llm.scratch import written

CAPACITY, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one rank block: what one task orders at a time.
BLOCK_ROWS = 4096


def _bytes_of_unicode() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: those that
    print stand for themselves, the others for 256, 257 and so on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> ids of the byte-level BPE file at `path`, as the tokenizers library gives them.

    The merges run in tiktoken, several times faster with the same vocabulary; a
    text that spells one of the file's special tokens goes to tokenizers itself,
    which is loaded at the first such text.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]
    table = _bytes_of_unicode()
    ranks = {bytes(table[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @lru_cache(maxsize=1)
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return exact().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a first that may be shorter."""
    first = n % capacity or capacity
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids and the end id; with their ids if asked for."""
    path = path or default_path()

    @given_back
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows["doc_id"].append(doc_id)
                    rows["piece"].append(k)
                    rows["start"].append(start)
                    rows["length"].append(length)
                    rows["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        rows["ids"].append(part.astype("<i4"))
                        held += length
                if held > 1 << 20:
                    yield _batch(rows, with_ids)
                    rows, held = {k: [] for k in rows}, 0
            if rows["doc_id"]:
                yield _batch(rows, with_ids)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def _batch(rows: dict, with_ids: bool) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in rows.items() if k != "ids" or with_ids})


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The fullest combination, as (length, times), that holds the longest length of `counts`.

    reach[i] is a bitset of the sums that the i longest lengths can make, from
    which the combination is read backwards; of equal ones, that with long items.
    """
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        times = min(counts[length] - (length == first), room // length)
        part = 1
        while times > 0:  # binary splitting of the count
            take = min(part, times)
            new = (reach | reach << (take * length)) & mask
            steps.append((length, take, reach))
            reach, times, part = new, times - take, part * 2
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    found = {first: 1}
    for length, take, before in reversed(steps):
        if not before >> left & 1:
            left -= take * length
            found[length] = found.get(length, 0) + take
    return sorted(found.items(), reverse=True)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Combinations in the order of packing: (bins, [(length, times)])."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    plan = []
    while counts:
        combo = fullest(counts, capacity)
        bins = min(counts[length] // times for length, times in combo)
        for length, times in combo:
            counts[length] -= bins * times
            if not counts[length]:
                del counts[length]
        plan.append((bins, combo))
    return plan


def _segments(plan) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first bin, times in a bin, offset in the bin)."""
    base, taken, rows = 0, {}, {}
    for bins, combo in plan:
        offset = 0
        for length, times in combo:
            at = taken.get(length, 0)
            rows.setdefault(length, []).append((at, base, times, offset))
            taken[length] = at + bins * times
            offset += times * length
        base += bins
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def ranked(pieces: DataFrame) -> DataFrame:
    """`pieces` with rank, from 0 within each length, by (block, doc_id, piece).

    Rows are dealt to blocks by a hash of the id within the length, counts by
    block are summed up in front of each block, and ranks run within the blocks.
    """
    n = pieces.count()
    blocks = max(1, min(1 << 20, -(-n // BLOCK_ROWS)))
    rows = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    counts = rows.groupBy("length", "block").agg(F.count(F.lit(1)).alias("held"))
    ahead = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "block", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        rows.withColumn("at", F.row_number().over(within) - 1)
        .join(counts, ["length", "block"])
        .withColumn("rank", F.col("ahead") + F.col("at"))
        .drop("block", "ahead", "at")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces with sequence_id and offset: where each stands in the packed sequences.

    token_pieces(docs, with_ids=True) gives the ids to write there.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, capacity, path), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = spark.sparkContext.broadcast(_segments(pack_histogram(histogram, capacity)))

    @given_back
    def place(batches):
        table = segments.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                rows = table[int(one)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                bin_, slot = np.divmod(rank[at] - row[:, 0], row[:, 2])
                sequence[at] = row[:, 1] + bin_
                offset[at] = row[:, 3] + slot * one
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    ordered = ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ordered.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op7_bin_packing(docs: DataFrame) -> DataFrame:
    """Digest of the packing: one row for each piece."""
    return pack_documents(docs)
