"""Suffix-array dedup: prefix doubling over the positions that can repeat.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere.
Ranking every position of a corpus by its next LENGTH bytes would sort each of
them several times, as `suffix_doubling` does, so positions that can't repeat, or
do, are settled first:

1. Every window of LENGTH bytes has an anchor, the leftmost of its least ANCHOR-byte
   hashes. Equal windows have equal anchors. A run is a stretch of windows with one
   anchor; it is dealt by the anchor's hash, about one run for 70 bytes.
2. An anchor that occurs once settles its run: nothing repeats. Runs with the
   same 128-bit hash, for which the same bytes are taken, settle each other: every
   window repeats. What is left are the
   edges: runs whose anchor is shared, but not all their bytes.
3. For the edges, runs go to their anchor's task with their bytes, one of each
   kind. There positions are sorted by pairs of ranks at growing offsets, 25, 50
   and 100: rank(i, 2h) orders (rank(i, h), rank(i + h, h)). A position that gets
   a rank of its own leaves; what shares its rank at LENGTH bytes repeats.
   Anchors with many kinds of runs are dealt further, by the first bytes of their
   windows, which equal windows share.

Spark deals runs and intervals; texts move twice, to the edges and to the
removal. Hashes of runs have 128 bits, from two tables and bases, and only meet
within one anchor's runs; those of anchors have 64 and lead to a comparison of the
runs themselves.

Defined results: a null text is empty; texts shorter than LENGTH keep all bytes;
repeated rows are documents of their own, so each repeats the other; an empty
table gives an empty result; matches never cross documents; columns other than id
and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.arrow import small_batches
from lodestar.llm.hashing import Roller, mixed
from lodestar.llm.scratch import written

LENGTH, ANCHOR = 200, 64
#: Offsets of the doubling, after names for the first of them.
OFFSETS = (25, 50, 100)
#: Bytes that are scanned at once, runs that are packed at once, kinds of runs that one task takes of an anchor,
#: and bytes of runs whose positions are ranked at once.
SEGMENT, PACK_RUNS, KINDS, RANK_BYTES = 1 << 20, 1 << 18, 4096, 1 << 21
PLACE = np.uint64((1 << 21) - 1)
_KEY = ["t1", "t2"]
_ROLLERS: dict[int, Roller] = {}


def _roller(seed: int = 5) -> Roller:
    if seed not in _ROLLERS:
        _ROLLERS[seed] = Roller(seed)
    return _ROLLERS[seed]


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, from running least values of blocks in both directions."""
    n = len(h)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(anchor hash, two run hashes, first window, windows) of the runs of a text."""
    out = []
    roller = _roller()
    for low in range(0, len(data) - length + 1, SEGMENT):
        part = data[low : low + SEGMENT + length - 1]
        sums = roller.sums(part)
        at = np.arange(len(part) - anchor + 1)
        h = mixed(roller.hashes(sums, at, at + anchor))
        # the place in the low bits makes the leftmost of equal hashes the anchor
        least = _sliding_least((h & ~PLACE) | at.astype(np.uint64), length - anchor + 1)
        edge = np.flatnonzero(least[1:] != least[:-1]) + 1
        start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(least)]])
        size = (end - start).astype(np.uint64)
        whole = [mixed(r.hashes(s, start, end + length - 1) + size) for r, s in ((roller, sums), (_roller(6), _roller(6).sums(part)))]
        out.append((h[(least[start] & PLACE).astype(np.int64)], *whole, start + low, end - start))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


RUNS = np.dtype([("g", "<u8"), ("r", "<u8"), ("q", "<u8"), ("doc", "<i4"), ("s", "<i4"), ("n", "<i4")])
DOCS = np.dtype([("t1", "<i8"), ("t2", "<i8"), ("d", "<i8")])
EDGE = np.dtype([("g", "<u8"), ("r", "<u8"), ("q", "<u8"), ("s", "<i4"), ("n", "<i4"), ("open", "<i4"), ("kinds", "<i4")])


def _packed_runs(parts: int, length: int):
    def run(batches):
        def emit(runs, docs):
            runs, table = np.concatenate(runs), np.array(docs, DOCS)
            part = (runs["g"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            runs, part = runs[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            rows = {"part": [], "runs": [], "docs": []}
            for k in np.unique(part):
                own = runs[cuts[k] : cuts[k + 1]].copy()
                used, own["doc"] = np.unique(own["doc"], return_inverse=True)
                rows["part"].append(int(k))
                rows["runs"].append(own.tobytes())
                rows["docs"].append(table[used].tobytes())
            return pa.RecordBatch.from_pydict(
                {"part": pa.array(rows["part"], pa.int32()), "runs": pa.array(rows["runs"], pa.binary()), "docs": pa.array(rows["docs"], pa.binary())}
            )

        runs, docs, held = [], [], 0
        for batch in batches:
            t1, t2, d, texts = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                data = np.frombuffer(texts[i].as_py().encode(), np.uint8)
                if len(data) < length:
                    continue
                rows = None
                for c, x in zip(("g", "r", "q", "s", "n"), runs_of(data, length), strict=True):
                    rows = np.empty(len(x), RUNS) if rows is None else rows
                    rows[c] = x
                rows["doc"] = len(docs)
                docs.append((t1[i].as_py(), t2[i].as_py(), d[i].as_py()))
                runs.append(rows)
                held += len(rows)
                if held >= PACK_RUNS:
                    yield emit(runs, docs)
                    runs, docs, held = [], [], 0
        if runs:
            yield emit(runs, docs)

    return run


def _by_document(doc: np.ndarray, table: np.ndarray, kind: str, values: np.ndarray):
    """A row (t1, t2, d, kind, payload) for each document of `doc`, which is sorted."""
    cut = np.concatenate([np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), [len(doc)]])
    own = table[doc[cut[:-1]]]
    return pa.RecordBatch.from_arrays(
        [pa.array(own["t1"]), pa.array(own["t2"]), pa.array(own["d"]), pa.array([kind] * len(own), pa.string()),
         pa.array([values[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
        names=["t1", "t2", "d", "kind", "payload"],
    )


def _settle(length: int):
    def run(batches):
        runs, tables, docs = [], [], 0
        for batch in batches:
            for raw, raw_docs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(raw, RUNS).copy()
                table = np.frombuffer(raw_docs, DOCS)
                own["doc"] += docs
                docs += len(table)
                runs.append(own)
                tables.append(table)
        if not runs:
            return
        runs, table = np.concatenate(runs), np.concatenate(tables)
        # documents of one text are one document here
        _, table_at, same = np.unique(table[["t1", "t2"]], return_index=True, return_inverse=True)
        table = table[table_at]
        runs = runs[np.lexsort((runs["q"], runs["r"], runs["g"]))]
        runs["doc"] = same[runs["doc"]]
        g, r = runs["g"], runs["r"]
        new_g = np.append(True, g[1:] != g[:-1])
        new_r = new_g | np.append(True, (r[1:] != r[:-1]) | (runs["q"][1:] != runs["q"][:-1]))
        g_id, r_id = np.cumsum(new_g) - 1, np.cumsum(new_r) - 1
        held = np.bincount(r_id)
        kinds = np.bincount(g_id[new_r])
        repeated = runs[held[r_id] > 1]
        if len(repeated):
            span = np.empty(len(repeated), [("doc", "<i8"), ("s", "<i4"), ("e", "<i4")])
            span["doc"], span["s"], span["e"] = repeated["doc"], repeated["s"], repeated["s"] + repeated["n"] + length - 1
            span = np.unique(span)
            yield _by_document(span["doc"], table, "gone", np.stack([span["s"], span["e"]], 1))
        one = np.flatnonzero(new_r)
        single = np.bincount(g_id[one], held[r_id[one]] == 1) > 0
        one = one[(kinds[g_id[one]] > 1) & single[g_id[one]]]
        if len(one):
            edge = np.empty(len(one), EDGE)
            for c in ("g", "r", "q", "s", "n"):
                edge[c] = runs[c][one]
            edge["open"], edge["kinds"] = held[r_id[one]] == 1, kinds[g_id[one]]
            doc = runs["doc"][one]
            order = np.argsort(doc, kind="stable")
            yield _by_document(doc[order], table, "edge", edge[order])

    return run


SPAN = "part int, g long, r long, q long, sub int, subs int, open int, t1 long, t2 long, s int, n int, data binary"


def _edge_bytes(parts: int, length: int):
    """Rows of SPAN: each edge run with its bytes, dealt by anchor."""

    def run(batches):
        roller = _roller()
        names = [x.split()[0] for x in SPAN.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            rows, held = [], 0
            for t1, t2, text, payloads in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for payload in payloads:
                    for e in np.frombuffer(payload, EDGE):
                        s, n, g = int(e["s"]), int(e["n"]), int(e["g"])
                        own = data[s : s + n + length - 1]
                        subs = -(-int(e["kinds"]) // KINDS)
                        mine = range(1)
                        if subs > 1:
                            mine = np.unique(_sub(roller, own, n, subs)).tolist()
                        for sub in mine:
                            rows.append(((g + 7919 * sub) % parts, g - (1 << 64) * (g >> 63), int(e["r"].astype(np.int64)), int(e["q"].astype(np.int64)), sub, subs, int(e["open"]), t1, t2, s, n, own))
                            held += len(own)
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _sub(roller: Roller, data: bytes, n: int, subs: int) -> np.ndarray:
    """The part of its anchor that each of a run's n windows belongs to."""
    at = np.arange(n)
    sums = roller.sums(np.frombuffer(data, np.uint8))
    return (mixed(roller.hashes(sums, at, at + OFFSETS[0])) % np.uint64(subs)).astype(np.int64)


def repeated_starts(data: np.ndarray, end: np.ndarray, counted: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which positions start a string of `length` bytes that another counted position starts too.

    end: for each position, where its text ends. Ranks double from the first offset.
    """
    roller = _roller()
    at = np.flatnonzero(np.arange(len(data)) + OFFSETS[0] <= end)
    key = roller.hashes(roller.sums(data), at, at + OFFSETS[0])
    rank = np.full(len(data), -1, np.int64)

    def rerank(at: np.ndarray, key: np.ndarray) -> None:
        _, which, held = np.unique(key, return_inverse=True, return_counts=True)
        rank[:] = -1
        shared = held[which] > 1
        rank[at[shared]] = which[shared]

    rerank(at, key)
    reach = OFFSETS[0]
    while reach < length:
        step = min(reach, length - reach)
        at = np.flatnonzero(rank >= 0)
        at = at[at + reach + step <= end[at]]
        if reach + step >= length:
            at = at[counted[at]]
        at = at[rank[at + step] >= 0]
        rerank(at, rank[at] * np.int64(len(data) + 1) + rank[at + step])
        reach += step
    return rank >= 0


def _resolve(length: int):
    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        rows = pa.concat_tables(tables)
        cols = {c: rows.column(c).to_numpy() for c in ("g", "r", "q", "sub", "subs", "open", "t1", "t2", "s", "n")}
        # repeated rows bring a run twice
        order = np.lexsort((cols["q"], cols["r"], cols["sub"], cols["g"]))
        same = np.ones(len(order), bool)
        for c in ("g", "sub", "r", "q"):
            v = cols[c][order]
            same &= np.append(False, v[1:] == v[:-1])
        order = order[~same]
        texts = rows.column("data").combine_chunks()
        sizes = cols["n"][order].astype(np.int64) + length - 1
        g, sub = cols["g"][order], cols["sub"][order]
        new = np.append(True, (g[1:] != g[:-1]) | (sub[1:] != sub[:-1]))
        firsts = np.append(np.flatnonzero(new), len(order))
        total = np.concatenate([[0], np.cumsum(sizes)])
        a = 0
        while a < len(firsts) - 1:  # whole anchors, about RANK_BYTES at a time
            b = max(a + 1, int(np.searchsorted(total[firsts], total[firsts[a]] + RANK_BYTES, side="right")) - 1)
            mine = order[firsts[a] : firsts[b]]
            a = b
            data = np.frombuffer(b"".join(texts[int(i)].as_py() for i in mine), np.uint8)
            size = cols["n"][mine].astype(np.int64) + length - 1
            last = np.cumsum(size)
            first = last - size
            owner = np.repeat(np.arange(len(mine)), size)
            end = last[owner]
            counted = np.arange(len(data)) + length <= end
            for i in np.flatnonzero(cols["subs"][mine] > 1):
                n = int(cols["n"][mine[i]])
                part = _sub(_roller(), data[first[i] : last[i]].tobytes(), n, int(cols["subs"][mine[i]]))
                counted[first[i] : first[i] + n] &= part == cols["sub"][mine[i]]
            hit = np.flatnonzero(repeated_starts(data, end, counted, length) & counted & (cols["open"][mine][owner] == 1))
            if not len(hit):
                continue
            row = mine[owner[hit]]
            s = cols["s"][row] + (hit - first[owner[hit]])
            doc = np.empty(len(row), DOCS)
            doc["t1"], doc["t2"], doc["d"] = cols["t1"][row], cols["t2"][row], 0
            table, which = np.unique(doc, return_inverse=True)
            by = np.lexsort((s, which))
            which, s = which[by], s[by]
            begin = np.append(True, (which[1:] != which[:-1]) | (s[1:] > s[:-1] + 1))
            at = np.flatnonzero(begin)
            stop = np.append(at[1:], len(s)) - 1
            spans = np.stack([s[at], s[stop] + length], 1).astype("<i4")
            yield _by_document(which[at], table, "gone", spans)

    return run


def _merged(payloads: list[bytes]) -> np.ndarray:
    """Maximal runs of the intervals, as rows (start, end)."""
    spans = np.frombuffer(b"".join(payloads), "<i4").reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], 1)


def _remove(batches):
    for batch in batches:
        kept, spans, sizes = [], [], []
        for text, payloads in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = (text or "").encode()
            own = _merged(payloads) if payloads else np.empty((0, 2), np.int64)
            if len(own):
                at = np.concatenate([[0], own.ravel(), [len(data)]])
                kept.append(b"".join(data[a:b] for a, b in at.reshape(-1, 2)))
            else:
                kept.append(data)
            sizes.append(len(data))
            spans.append([{"start": int(a), "end": int(b)} for a, b in own])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array(kept, pa.binary())],
            names=["doc", "n_bytes", "removed", "kept"],
        )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (t1, t2, payload): for texts with bytes to remove, by text hash, the intervals as packed pairs."""
    parts = int(small_batches(docs).sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(
        F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2"), F.xxhash64(id_col).alias("d"), F.col(text_col).alias("text")
    ).where(F.length(text_col) > 0)
    runs = texts.mapInArrow(_packed_runs(parts, length), "part int, runs binary, docs binary")
    settled = runs.repartitionById(parts, "part").mapInArrow(_settle(length), "t1 long, t2 long, d long, kind string, payload binary")
    settled = written(settled, "settled")
    edges = settled.where("kind = 'edge'").groupBy("t1", "t2", "d").agg(F.collect_list("payload").alias("edges"))
    edges = written(edges, "edges")
    spans = texts.join(edges, ["t1", "t2", "d"]).select("t1", "t2", "text", "edges").mapInArrow(_edge_bytes(parts, length), SPAN)
    found = spans.repartitionById(parts, "part").mapInArrow(_resolve(length), "t1 long, t2 long, d long, kind string, payload binary")
    gone = settled.where("kind = 'gone'").select(*_KEY, "payload").union(found.select(*_KEY, "payload"))
    return written(gone.groupBy(*_KEY).agg(F.collect_list("payload").alias("payload")), "gone")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (id, n_bytes, removed, kept): removed byte spans and the bytes that stay."""
    if length < 2 * OFFSETS[0] or length <= ANCHOR:
        raise ValueError("length must be more than the anchor and twice the first offset")
    gone = repeated_spans(docs, id_col, text_col, length)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t1"),
                       F.xxhash64(F.lit(1), text_col).alias("t2"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = f"doc {kind}, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary"
    joined = rows.join(gone, _KEY, "left").select("doc", "text", "payload")
    return joined.mapInArrow(_remove, out).withColumnRenamed("doc", id_col)


def op5_suffix_dedup(docs: DataFrame) -> DataFrame:
    """Digest of the removal: one row for each document."""
    found = dedup_substrings(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
