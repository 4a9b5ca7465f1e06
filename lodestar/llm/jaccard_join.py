"""N-gram Jaccard join: a grouped prefix join over word shingles.

1. A document's set is its distinct word shingles, as 64-bit hashes. All sets
   share one order: shingles that are frequent in the corpus stand last, the rest
   by hash. The order only says what is cheap; any order gives the same links.
2. Documents with equal sets are one set; sets of one size with an equal prefix
   are one group. Two sets that link share a token of their prefixes, and at
   their first shared token the sizes and places leave room for the overlap. So
   in a token's bucket only pairs of groups whose sizes and places leave that room
   are possible; rows without a possible partner leave the bucket.
3. What is left is verified in two rounds. First every set meets its buckets'
   pivot, the row with the fewest rarer tokens in front; links so found are
   joined to components. Then only rows of one bucket whose components still
   differ are paired, so a large group of near copies costs one pair for each
   copy, while no two sets that link stay apart.
4. Pairs are verified exactly. Whole sets are compared only where a bound on the
   overlap, by counters of each set in proportion to its size, leaves a link
   possible. The first round's comparisons leave each set as its few differences
   from a set that many are near. In the second round the sets of one such
   reference are compared by these differences, a block at a time, and only pairs
   of different references are paired and compared as whole sets.

A token's bucket is worked on where its rows have been dealt, by the token. Tokens
that many documents hold are dealt by their group as well, and their buckets are
Spark joins over (token, size, place) instead, with salts.

Set hashes collide with a probability of about 1e-14 for a pair of 500-word
texts, sets by their 128-bit digests practically never.

Defined results: a null or empty text has an empty set and links with nothing; a
text of fewer words than a shingle has its whole word sequence as one; rows with
equal texts link unless empty; rows without an id link like all others, and their
component_id is null if no row of the component has an id; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.arrow import given_back, small_batches
from lodestar.llm.components import components
from lodestar.llm.hashing import Roller, mixed
from lodestar.llm.scratch import free, scope, written

#: Frequent shingles that the order knows at most, and their least count within a task's buffer.
FREQUENT, LEAST_COUNT = 1 << 20, 2
#: Documents from which on a token's rows are dealt by group too, and rows of a bucket that is worked on in one task.
HOT_DOCUMENTS, BUCKET_ROWS = 512, 4096
#: Text bytes hashed at once, hashes counted and tokens packed at once, pairs of rows looked at once, parts of a hot key.
CHUNK_BYTES, COUNT_ROWS, PACK_ROWS, PAIR_ROWS, SALTS = 1 << 18, 1 << 19, 1 << 18, 1 << 20, 16
#: Tokens of a set for each of its counters, about, and least counters.
COUNTER_TOKENS, LEAST_COUNTERS = 6, 16
#: Percent below a link down to which a compared pair's differences are kept as references.
NEAR_SLACK = 30
#: Ids that are broadcast at most: some tens of megabytes.
BROADCAST_IDS = 1 << 20
#: Sets of one reference that are compared at once.
BLOCK_SETS = 256
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ROLLERS: dict[bool, Roller] = {}


def _roller() -> Roller:
    return _ROLLERS.setdefault(True, Roller(20, lower=True))


def _word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word of texts that stand one after another and end at `ends`."""
    word = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    edge[0] = True
    start = np.flatnonzero(word & (edge[:-1] | ~np.append(False, word[:-1])))
    end = np.flatnonzero(word & (edge[1:] | ~np.append(word[1:], False))) + 1
    roller = _roller()
    h = mixed(roller.hashes(roller.sums(data), start, end))
    return h, np.searchsorted(ends, start, side="right")


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    h, owner = _word_hashes(data, ends) if len(data) else (np.empty(0, np.uint64), np.empty(0, np.int64))
    rolled = h.copy()
    n = np.bincount(owner, minlength=len(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    with np.errstate(over="ignore"):
        for k in range(1, width):
            rolled[: len(h) - k] = mixed(rolled[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]) if len(h) > k else rolled[:0]
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(np.frombuffer(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _chunks(column, size: int = CHUNK_BYTES):
    """(first row, texts as bytes) of a text column, about `size` bytes at a time."""
    texts, held, first = [], 0, 0
    rows = (x for a in range(0, len(column), 256) for x in column.slice(a, 256).to_pylist())
    for i, text in enumerate(rows):
        data = (text or "").encode()
        if texts and held + len(data) > size:
            yield first, texts
            texts, held, first = [], 0, i
        texts.append(data)
        held += len(data)
    if texts:
        yield first, texts


@dataclass
class Order:
    """The shingles that stand last: their hashes, ascending, the rank of each, and those that many documents hold."""

    known: np.ndarray
    rank: np.ndarray
    hot: np.ndarray

    @staticmethod
    def of(h: np.ndarray, n: np.ndarray) -> Order:
        """h: hashes as signed numbers, n: their counts; ranks go by count."""
        rank = np.empty(len(h), np.int32)
        rank[np.lexsort((h, n))] = np.arange(len(h), dtype=np.int32)
        by = np.argsort(h.view(np.uint64))
        return Order(h[by].view(np.uint64), rank[by], np.sort(h[n >= HOT_DOCUMENTS]))

    def sorted(self, s: np.ndarray) -> np.ndarray:
        """The hashes of a set in this order."""
        at, late = _among(s, self.known)
        return np.concatenate([s[~late], s[late][np.argsort(self.rank[at[late]], kind="stable")]])


def _among(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each x its place in the ascending `known`, and whether it is there."""
    if not len(known):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return at, known[at] == x


def frequent_shingles(docs: DataFrame, text_col: str, width: int) -> Order:
    """Up to FREQUENT shingles, those of most documents, by approximate counts.

    All documents are read, but a shingle that comes fewer than LEAST_COUNT times
    within a buffer of about COUNT_ROWS hashes isn't counted there, so one that is
    spread thinly over many buffers is undercounted or missed. Links don't depend on
    it: a bucket that grows large without being known as hot is handed to the joins
    for hot ones where it is found.
    """

    @given_back
    def count(batches):
        def emit(held):
            values, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= LEAST_COUNT
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n[keep])], names=["h", "n"])

        held, rows = [], 0
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                sets = shingle_sets(texts, width)
                held += sets
                rows += sum(map(len, sets))
                if rows >= COUNT_ROWS:
                    yield emit(held)
                    held, rows = [], 0
        if held:
            yield emit(held)

    counted = docs.select(text_col).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = written(counted.withColumn("level", F.floor(F.ln("n") * 100)), "shingle-counts")
    # levels are logarithms, so there are a few thousand at most
    sizes = counted.groupBy("level").agg(F.count(F.lit(1)).alias("held")).collect()
    level, room = None, FREQUENT
    for row in sorted(sizes, key=lambda r: -r["level"]):
        room -= row["held"]
        if room < 0:
            break
        level = row["level"]
    if level is None:
        return Order.of(np.empty(0, np.int64), np.empty(0, np.int64))
    top = counted.where(F.col("level") >= level).select("h", "n").toArrow()
    return Order.of(*(top.column(c).to_numpy() for c in ("h", "n")))


def _least_share(percent: int, n: np.ndarray | int):
    return -(-percent * n // 100)


def text_key(text_col: str) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(text_col).alias("text_key")


def set_rows(docs: DataFrame, order: Order, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Rows (id, text_key, n, sig, gk, prefix, counters): size, digest, group, ordered prefix and counters of each set."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    @given_back
    def run(batches):
        order = shared.value
        for batch in batches:
            ids = batch.column(0)
            for first, texts in _chunks(batch.column(2)):
                sets = shingle_sets(texts, width)
                prefixes = [order.sorted(s)[: len(s) - _least_share(percent, len(s)) + 1].view(np.int64) if len(s) else s.view(np.int64) for s in sets]
                groups = [
                    int.from_bytes(hashlib.blake2b(p.tobytes(), digest_size=8, salt=str(len(s)).encode()).digest(), "little", signed=True)
                    for s, p in zip(sets, prefixes, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array([len(s) for s in sets], pa.int64()), _digests(sets),
                     pa.array(groups, pa.int64()), pa.array([p.tobytes() for p in prefixes], pa.binary()), pa.array(map(_counters, sets), pa.binary())],
                    names=["id", "text_key", "n", "sig", "gk", "prefix", "counters"],
                )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    given = docs.select(id_col, text_key(text_col), text_col)
    return given.mapInArrow(run, f"id {kind}, text_key long, n long, sig binary, gk long, prefix binary, counters binary")


def _counters(s: np.ndarray) -> bytes:
    """How many tokens of a set fall in each of 2**k parts of the hashes, after one byte for k and one for their width."""
    k = max(LEAST_COUNTERS, len(s) // COUNTER_TOKENS).bit_length() - 1
    n = np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    width = 1 if n.max(initial=0) < 1 << 8 else 4
    return bytes((k, width)) + n.astype(f"<u{width}").tobytes()


def _most_overlap(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bound on the overlap of each pair of sets, from their counters; the finer ones are added up to the coarser."""
    out = np.zeros(len(a), np.int64)
    kinds: dict[bytes, list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        kinds.setdefault(x[:2] + y[:2], []).append(i)
    for kind, at in kinds.items():
        k = min(kind[0], kind[2])
        rows = [
            np.frombuffer(b"".join(side[i][2:] for i in at), f"<u{width}").reshape(len(at), 1 << k, -1).sum(2, dtype=np.int64)
            for side, width in ((a, kind[1]), (b, kind[3]))
        ]
        out[at] = np.minimum(*rows).sum(1)
    return out


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())


def whole_sets(texts: DataFrame, width: int) -> DataFrame:
    """Rows (sid, tokens): whole sets, from rows (sid, sig, text); texts of another set than sig are left out."""

    @given_back
    def run(batches):
        for batch in batches:
            for first, texts in _chunks(batch.column(2)):
                sets = shingle_sets(texts, width)
                sid, sig = (batch.column(i).slice(first, len(texts)) for i in (0, 1))
                mine = np.flatnonzero([x == y for x, y in zip(sig.to_pylist(), _digests(sets).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [sid.take(pa.array(mine)), pa.array([sets[i].view(np.int64) for i in mine], pa.list_(pa.int64()))], names=["sid", "tokens"])

    return texts.select("sid", "sig", "text").mapInArrow(run, "sid long, tokens array<long>")


TOKEN = np.dtype([("t", "<i8"), ("gk", "<i8"), ("n", "<i4"), ("pos", "<i4")])
PAIR = "a long, b long"


def _packed(own: np.ndarray) -> bytes:
    """Rows of TOKEN, column by column and small numbers byte by byte, which compresses well."""
    t, gk, n, pos = (np.ascontiguousarray(own[c]) for c in TOKEN.names)
    return b"".join([t.tobytes(), gk.tobytes(), *(x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in (n, pos))])


def _unpacked(raw: bytes) -> np.ndarray:
    own = np.empty(len(raw) // TOKEN.itemsize, TOKEN)
    m = len(own)
    own["t"], own["gk"] = np.frombuffer(raw, "<i8", 2 * m).reshape(2, m)
    for c, at in (("n", 16 * m), ("pos", 20 * m)):
        own[c] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * m, at).reshape(4, m).T).view("<i4").ravel()
    return own


def _ends(key: np.ndarray) -> np.ndarray:
    """For each row of equal keys that stand together, where they end."""
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.empty(0, bool)
    return np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1] if len(key) else np.empty(0, np.int64)


def _later_rows(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of each row i with the rows begin[i] to end[i], about PAIR_ROWS at a time."""
    count = end - begin
    upto = np.cumsum(count)
    a = 0
    while a < len(count):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + PAIR_ROWS, side="right")))
        i = np.repeat(np.arange(a, b), count[a:b])
        j = np.arange(len(i)) - np.repeat(upto[a:b] - count[a:b] - done, count[a:b]) + begin[i]
        if len(i):
            yield i, j
        a = b


def _fits(n, pos, i, j, percent: int) -> np.ndarray:
    """Whether the sizes and places of a shared token leave room for a link."""
    room = np.minimum(n[i] - pos[i], n[j] - pos[j]).astype(np.int64)
    return room * (100 + percent) >= (n[i].astype(np.int64) + n[j]) * percent


def shared_tokens(rows: DataFrame, order: Order, percent: int) -> DataFrame:
    """Rows (token, gk, n, pos, hot, pivot) of prefix tokens that two groups or more may hold.

    Tokens are dealt by their hash as packed arrays. A bucket of some rows is worked
    on where it meets: rows with a possible partner leave the task, with the group
    of the bucket's pivot if a link with it is possible. Tokens that many documents
    hold are dealt by their group too; all their rows leave, marked hot.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = rows.sparkSession.sparkContext.broadcast(order.hot)

    @given_back
    def pack(batches):
        def emit(held):
            own = np.unique(np.concatenate(held))  # copies within the buffer fall together
            t, gk = (own[c].view(np.uint64) for c in ("t", "gk"))
            with np.errstate(over="ignore"):
                place = mixed(np.where(_among(own["t"], shared.value)[1], mixed(t + mixed(gk)), t))
            part = (place % np.uint64(parts)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            own, cuts = own[by], np.searchsorted(part[by], np.arange(parts + 1))
            used = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array([_packed(own[cuts[k] : cuts[k + 1]]) for k in used], pa.binary())],
                names=["part", "payload"],
            )

        held, rows = [], 0
        for batch in batches:
            for n, gk, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(raw, np.int64)
                own = np.empty(len(tokens), TOKEN)
                own["t"], own["gk"], own["n"], own["pos"] = tokens, gk, n, np.arange(len(tokens))
                held.append(own)
                rows += len(own)
                if rows >= PACK_ROWS:
                    yield emit(held)
                    held, rows = [], 0
        if held:
            yield emit(held)

    @given_back
    def keep(batches):
        held = [_unpacked(p) for batch in batches for p in batch.column(1).to_pylist()]
        if not held:
            return
        own = np.unique(np.concatenate(held))
        del held
        own = own[np.lexsort((own["gk"], own["n"], own["pos"], own["t"]))]  # the pivot first
        end = _ends(own["t"])
        begin = len(own) - _ends(own["t"][::-1])[::-1]
        hot = _among(own["t"], shared.value)[1] | (end - begin > BUCKET_ROWS)
        use = hot.copy()
        later = np.where(hot, end, np.arange(len(own)) + 1)
        for i, j in _later_rows(later, end):
            ok = _fits(own["n"], own["pos"], i, j, percent)
            use[i[ok]] = use[j[ok]] = True
        with_pivot = use & ~hot & (np.arange(len(own)) > begin)
        with_pivot &= _fits(own["n"], own["pos"], np.arange(len(own)), begin, percent)
        pivot = own["gk"][begin]
        at = np.flatnonzero(use)
        for a in range(0, len(at), 1 << 16):
            k = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(own[c][k]) for c in ("t", "gk", "n", "pos")], pa.array(hot[k]), pa.array(pivot[k], mask=~with_pivot[k])],
                names=["token", "gk", "n", "pos", "hot", "pivot"])

    packed = rows.select("n", "gk", "prefix").mapInArrow(pack, "part int, payload binary")
    return packed.repartitionById(parts, "part").mapInArrow(keep, "token long, gk long, n int, pos int, hot boolean, pivot long")


def _bucket_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b): possible pairs of rows of one token whose components and references differ, from rows (token, n, pos, sid, component, ref)."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @given_back
    def run(batches):
        batches = list(batches)
        if not batches:
            return
        c = [np.concatenate([b.column(k).to_numpy() for b in batches]) for k in range(6)]
        by = np.lexsort((c[4], c[0]))
        token, n, pos, sid, component, ref = (x[by] for x in c)
        end = _ends(token)
        own_end = _ends(component)  # a component's rows stand together within the token
        found = []
        for i, j in _later_rows(np.minimum(own_end, end), end):
            ok = (ref[i] != ref[j]) & _fits(n, pos, i, j, percent)
            pairs = np.unique(np.stack([np.minimum(sid[i[ok]], sid[j[ok]]), np.maximum(sid[i[ok]], sid[j[ok]])], 1), axis=0)
            if len(pairs):
                found.append(pairs)
            if sum(map(len, found)) > PAIR_ROWS:
                yield _pair_batch(np.unique(np.concatenate(found), axis=0))
                found = []
        if found:
            yield _pair_batch(np.unique(np.concatenate(found), axis=0))

    return placed.select("token", "n", "pos", "sid", "component", "ref").repartition(parts, "token").mapInArrow(run, PAIR)


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])


def _enough(overlap: Column, sizes: Column, percent: int) -> Column:
    """100 * overlap >= percent * union, in whole numbers."""
    return overlap * (100 + percent) >= sizes * percent


def _possible(a: str, b: str, percent: int) -> Column:
    room = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return _enough(room, F.col(f"{a}.n") + F.col(f"{b}.n"), percent)


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """Rows (a, b, n_a, n_b, linked, a_only, b_only) of the pairs of set ids that are near, linked or not.

    a_only and b_only are the tokens that one of the two has. docs: rep, text.
    """
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda t, c, *extra: t.select(F.col("sid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in extra])
    bounded = pairs.join(side(sets, "a", "n", "counters"), "a").join(side(sets, "b", "n", "counters"), "b")

    @given_back
    def bound(batches):
        for batch in batches:
            if batch.num_rows:
                total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                most = _most_overlap(batch.column(4).to_pylist(), batch.column(5).to_pylist())
                yield pa.RecordBatch.from_arrays(batch.columns[:4], names=batch.schema.names[:4]).filter(pa.array(most * (100 + percent) >= total * percent))

    kept = bounded.select("a", "b", "n_a", "n_b", "counters_a", "counters_b").mapInArrow(bound, "a long, b long, n_a long, n_b long")
    kept = written(kept, f"{name}-bounded")
    # texts come by the id of a row that holds them; up to BROADCAST_IDS ids are broadcast, so texts don't move; beyond, both sides do
    wanted = kept.select(F.col("a").alias("sid")).union(kept.select("b")).distinct()
    wanted = written(sets.join(wanted, "sid", "left_semi").select("sid", "sig", "rep", "repeated"), f"{name}-wanted")
    small = wanted.count() <= BROADCAST_IDS
    plain = wanted.where("rep IS NOT NULL AND NOT repeated").drop("repeated")
    whole = whole_sets(docs.join(F.broadcast(plain) if small else plain, "rep"), width)
    # sets of rows without an id, or of repeated rows: one text of each
    odd = wanted.where("rep IS NULL OR repeated").drop("repeated").withColumnRenamed("rep", "o_rep")
    if not odd.isEmpty():
        found = docs.join(F.broadcast(odd) if small else odd, docs["rep"].eqNullSafe(F.col("o_rep")))
        whole = whole.union(whole_sets(found, width).dropDuplicates(["sid"]))
    whole = written(whole, f"{name}-sets")
    full = kept.join(side(whole, "a", "tokens"), "a").join(side(whole, "b", "tokens"), "b")
    full = full.select("a", "b", "n_a", "n_b", F.array_except("tokens_a", "tokens_b").alias("a_only"), F.array_except("tokens_b", "tokens_a").alias("b_only"))
    overlap = F.col("n_a") - F.size("a_only")
    total = F.col("n_a") + F.col("n_b")
    near = full.where(_enough(overlap, total, max(0, percent - NEAR_SLACK)))
    return written(near.withColumn("linked", _enough(overlap, total, percent)), name)


def _references(near: DataFrame) -> DataFrame:
    """Rows (sid, ref, n_ref, lost, own): each set as what it lacks and has against a set that many are near.

    Of itself and the sets that it was compared with, a set takes the one with most comparisons.
    """
    empty = F.array().cast("array<bigint>")
    seen = near.select(F.col("a").alias("sid"), F.col("b").alias("ref"), F.col("n_b").alias("n_ref"), F.col("b_only").alias("lost"), F.col("a_only").alias("own")).union(
        near.select(F.col("b").alias("sid"), F.col("a").alias("ref"), F.col("n_a").alias("n_ref"), F.col("a_only").alias("lost"), F.col("b_only").alias("own")))
    degree = written(seen.groupBy("ref").agg(F.count(F.lit(1)).alias("held"), F.first("n_ref").alias("n_ref")), "reference-degrees")
    salted = degree.select("ref", "held", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int")).join(salted, ["ref", "salt"])
    itself = degree.select(F.col("ref").alias("sid"), "ref", "n_ref", empty.alias("lost"), empty.alias("own"), "held")
    options = seen.select("sid", "ref", "n_ref", "lost", "own", "held").union(itself)
    best = options.groupBy("sid").agg(F.max_by(F.struct("ref", "n_ref", "lost", "own"), F.struct("held", -F.col("ref"))).alias("x"))
    return written(best.select("sid", "x.*"), "references")


def _within_references(references: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components among the sets of one reference.

    overlap = |ref| - |lost by a or b| + |own to both|, exactly, for all pairs of
    a block of sets at once by products of their 0-1 rows. Large references are
    dealt as pairs of blocks. Only links that join something leave a task.
    """
    rows = references.join(placed.select("sid", "component"), "sid")
    mixed_refs = rows.groupBy("ref").agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    blocks = F.ceil(F.col("held") / BLOCK_SETS).cast("int")
    mixed_refs = written(mixed_refs.select("ref", blocks.alias("blocks")), "mixed-references")
    salted = mixed_refs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int")).join(salted, ["ref", "salt"])
    own = F.pmod(F.xxhash64(F.lit(3), "sid"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("ref", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sid", "component", "n_ref", "lost", "own")

    def links(table: pa.Table) -> pa.Table:
        sid, comp = (table.column(c).to_numpy() for c in ("sid", "component"))
        n_ref = int(table.column("n_ref")[0].as_py())
        lost, n_lost = _rows_of(table.column("lost"))
        owned, n_own = _rows_of(table.column("own"))
        both_lost, both_own = lost @ lost.T, owned @ owned.T
        size = n_ref - n_lost + n_own
        overlap = n_ref - (n_lost[:, None] + n_lost[None, :] - both_lost) + both_own
        linked = overlap * (100 + percent) >= (size[:, None] + size[None, :]) * percent
        group = {int(c): int(c) for c in np.unique(comp)}

        def find(x):
            while group[x] != x:
                group[x] = group[group[x]]
                x = group[x]
            return x

        a, b = np.nonzero(np.triu(linked & (comp[:, None] != comp[None, :]), 1))
        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = find(int(comp[x])), find(int(comp[y]))
            if p != q:
                group[max(p, q)] = min(p, q)
                out.append((int(sid[x]), int(sid[y])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return written(rows.groupBy("ref", "i", "j").applyInArrow(links, "a long, b long"), "reference-links")


def _rows_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of tokens as 0-1 rows over their distinct tokens that two rows have, and the lists' sizes."""
    lists = column.combine_chunks()
    size = np.array([len(x) for x in lists], np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(size)), size)
    _, which, held = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(held > 1) - 1
    keep = held[which] > 1 if len(which) else np.empty(0, bool)
    rows = np.zeros((len(size), int((held > 1).sum())), np.float32)
    rows[owner[keep], place[which[keep]]] = 1
    return rows, size


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """Rows (id, n_shingles, component_id), one for each row of `docs`.

    Documents link when 100 * intersection >= percent * union of their sets;
    component_id is the least id that is reachable by links.
    """
    with scope() as keep:
        return _components_of(docs, id_col, text_col, width, percent, keep).select(id_col, "n_shingles", "component_id")


def standing_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                  percent: int = 80) -> DataFrame:
    """Rows (id, text_key, n_shingles, stands), one for each row of `docs`.

    Of each component the rows of one id and text stand: the least id, null last,
    and its least text key. Rows that link with nothing and empty texts stand.
    """
    with scope() as keep:
        return _components_of(docs, id_col, text_col, width, percent, keep).select(id_col, "text_key", "n_shingles", "stands")


def _components_of(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, keep) -> DataFrame:
    order = frequent_shingles(small_batches(docs), text_col, width)
    rows = keep(written(set_rows(docs, order, id_col, text_col, width, percent), "shingle-sets"))
    filled = rows.where("n > 0")
    own = F.struct(F.col("id").isNull().alias("nameless"), "id", "text_key")
    held = filled.groupBy("sig", "id").agg(F.count(F.lit(1)).alias("copies"), F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("n", "gk", "counters")])
    sets = held.groupBy("sig").agg(F.min("id").alias("rep"), F.min(own).alias("stand"), F.sum("copies").alias("copies"), (F.max("copies") > 1).alias("repeated"),
                                   *[F.first(c).alias(c) for c in ("n", "gk", "counters")])
    sets = written(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")

    tokens = written(shared_tokens(filled, order, percent), "shared-tokens")
    hot = tokens.where("hot").select("token", "gk", "n", "pos")
    per_token = hot.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("pos", "n", "gk")).alias("pivot")).where("held > 1")
    classes = written(hot.groupBy("token", "n", "pos").agg(F.count(F.lit(1)).alias("held")), "classes")
    # the classes of a token meet by salts of one side
    x = classes.withColumn("salt", F.pmod(F.xxhash64("n", "pos"), F.lit(SALTS)).cast("int")).alias("x")
    y = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("y")
    before = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.pos") <= F.col("y.pos")))
    same = (F.col("x.n") == F.col("y.n")) & (F.col("x.pos") == F.col("y.pos"))
    open_pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt"))).where(
        before & _possible("x", "y", percent) & (~same | (F.col("x.held") > 1))
    )
    open_pairs = written(
        open_pairs.select(F.col("x.token").alias("token"), F.col("x.n").alias("n_x"), F.col("x.pos").alias("pos_x"),
                          F.col("y.n").alias("n_y"), F.col("y.pos").alias("pos_y")), "open-classes")
    open_rows = open_pairs.select("token", F.col("n_x").alias("n"), F.col("pos_x").alias("pos")).union(
        open_pairs.select("token", F.col("n_y").alias("n"), F.col("pos_y").alias("pos"))).distinct()
    # a hot token's rows are dealt to salts where they meet its pivot
    salted = hot.join(open_rows, ["token", "n", "pos"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("gk"), F.lit(SALTS)).cast("int"))
    pivots = per_token.select("token", "pivot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hot = written(salted.join(pivots, ["token", "salt"]).select("token", "gk", "n", "pos", "pivot"), "hot-buckets")
    cold = tokens.where("NOT hot")
    bucket = cold.select("gk").union(hot.select("gk"))

    # sets of a group: the first stands for it where the group meets pivots
    heads = sets.groupBy("gk").agg(F.min("sid").alias("head"), F.count(F.lit(1)).alias("held"))
    heads = written(heads, "groups")
    wanted = bucket.union(heads.where("held > 1").select("gk")).distinct()
    member = written(sets.join(heads.drop("held"), "gk").join(wanted, "gk", "left_semi").select("sid", "gk", "head", "sig", "rep", "n"), "members")
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))

    with_pivot = hot.where("gk <> pivot.gk").select(
        F.struct("n", "pos").alias("x"), F.col("pivot").alias("y"), F.col("gk").alias("a"), F.col("pivot.gk").alias("b")
    )
    first = with_pivot.where(_possible("x", "y", percent)).select("a", "b")
    first = first.union(cold.where("pivot IS NOT NULL").select(F.col("gk").alias("a"), F.col("pivot").alias("b"))).distinct()
    of = lambda c: heads.select(F.col("gk").alias(c), F.col("head").alias(f"{c}_head"))
    first = first.join(of("a"), "a").join(of("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    first = first.union(member.where("sid <> head").select(F.col("sid").alias("a"), F.col("head").alias("b")))
    # what joins broadcast stays with the executors until the driver's garbage goes, which a large driver rarely looks for
    free(docs.sparkSession)
    near = _verified(first, sets, texts, width, percent, "first-links")
    free(docs.sparkSession)
    links = near.where("linked").select("a", "b")
    found = components(links)

    # second round: rows of a bucket whose components differ
    references = _references(near)
    at = member.join(found.withColumnRenamed("node", "sid"), "sid", "left").join(references.select("sid", "ref"), "sid", "left").select(
        "sid", "gk", F.coalesce("component", "sid").alias("component"), F.coalesce("ref", "sid").alias("ref"))
    at = written(at, "components")
    within = _within_references(references, at, percent)
    free(docs.sparkSession)
    at_rows = lambda t: t.select("token", "gk", "n", "pos").join(at, "gk").select("token", "n", "pos", "sid", "component", "ref")
    seen = written(at_rows(hot), "placed")
    spread = seen.groupBy("token", "n", "pos").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("ref").alias("low_ref"), F.max("ref").alias("high_ref"))
    named = lambda t, k, **extra: t.select("token", F.col("n").alias(f"n_{k}"), F.col("pos").alias(f"pos_{k}"), *[F.col(c).alias(n) for n, c in extra.items()])
    # pairs of one reference are settled; classes whose rows all have it, or one component, need no pairs
    still = (
        open_pairs.join(named(spread, "x", low_x="low", high_x="high", from_x="low_ref", to_x="high_ref"), ["token", "n_x", "pos_x"])
        .join(named(spread, "y", low_y="low", high_y="high", from_y="low_ref", to_y="high_ref"), ["token", "n_y", "pos_y"])
        .where((F.least("low_x", "low_y") < F.greatest("high_x", "high_y")) & (F.least("from_x", "from_y") < F.greatest("to_x", "to_y")))
        .select("token", "n_x", "pos_x", "n_y", "pos_y")
    )
    second = (
        still.join(named(seen, "x", a="sid", c_x="component", r_x="ref"), ["token", "n_x", "pos_x"])
        .join(named(seen, "y", b="sid", c_y="component", r_y="ref"), ["token", "n_y", "pos_y"])
        .where("c_x <> c_y AND r_x <> r_y")
        .select("a", "b")
    )
    inside = at.alias("x").join(at.alias("y"), F.col("x.gk") == F.col("y.gk")).where(
        (F.col("x.component") < F.col("y.component")) & (F.col("x.ref") != F.col("y.ref"))
    ).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
    more = _verified(_bucket_pairs(at_rows(cold), percent).union(second).union(inside), sets, texts, width, percent, "second-links").where("linked").select("a", "b")
    free(docs.sparkSession)
    all_found = components(links.union(within).union(more))
    free(docs.sparkSession)

    part = sets.select("sid", "sig", "rep", "stand", "copies").join(all_found.withColumnRenamed("node", "sid"), "sid", "left")
    part = part.where("component IS NOT NULL OR copies > 1").withColumn("component", F.coalesce("component", "sid"))
    least = part.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("stand").alias("stand"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = part.drop("stand").withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(SALTS)).cast("int"))
    of_sig = keep(written(part.join(least, ["component", "salt"]).select("sig", "component_id", "stand"), "set-components"))
    of_sig = of_sig.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.select("id", "text_key", "n", "sig").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return out.join(of_sig, ["sig", "salt"], "left").select(
        F.col("id").alias(id_col), "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
        (F.col("stand").isNull() | (F.col("stand.id").eqNullSafe(F.col("id")) & (F.col("stand.text_key") == F.col("text_key")))).alias("stands"),
    )


def op10_jaccard_join(docs: DataFrame) -> DataFrame:
    """Classes of documents under links of 90 % over three-word shingles."""
    return link_components(docs.select("doc_id", "text"), width=3, percent=90)
