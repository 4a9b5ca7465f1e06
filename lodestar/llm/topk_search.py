"""Exact top-k search over an impact-ordered, score-at-a-time index.

Vectors are dealt to shards. A shard's index holds, for each dimension, posting
segments: the rows whose component has the same quantised impact. A query takes
its dimensions' segments one impact level at a time, highest impact first, which
is from the greatest component down where the query is positive and from the least
up where it is negative; each segment adds its products to the rows' scores. After
a level, what a row can still gain in the dimensions that it hasn't been met in is
bounded by the impact of the next level. A query stops once few rows can reach the
k-th best score known, which is the proof that all others are out; the rows that
may be members are scored again exactly. A query without such proof goes through
all levels, after which its sums are the exact scores.

The k-th best score known is shared: some shards, one in SEED_SHARDS, are searched
first, each by the best k rows it has met itself, and their k-th best scores over
all of them are what the rows of all other shards must reach.

Queries and vectors meet in groups of (shard, query block) of bounded size, each
a task's work; best rows of the shards are merged by query.

Defined results: vectors that are null or empty or hold null or non-finite
components take no part; vectors meet only those of their dimension; a query
never meets rows of its own id; repeated rows are rows of their own, but a query
id is answered once, from its first vector in order of components; ties go to
the smaller id; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.scratch import written

K, QUERY_STEP, SCALE = 20, 20, 64.0
#: Impact levels of an index; rows of a shard, queries of a block, and those of them that are worked on at once.
LEVELS, SHARD_ROWS, BLOCK_QUERIES, BATCH_QUERIES = 16, 4096, 2048, 256
#: Least shards, and of how many shards one is searched first.
LEAST_SHARDS, SEED_SHARDS = 32, 8
#: Share of a shard's rows, at most, that a query which stops scores again.
RESCORED = 1 / 32


def quantised(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component, or null if the vector takes no part."""
    usable = (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("bigint")))


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, ties to smaller ids."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


class Postings:
    """The segments of a shard: for each dimension its rows by level, the greatest components in level 0."""

    def __init__(self, x: np.ndarray, levels: int):
        self.x = x
        self.high, low = int(x.max()), int(x.min())
        self.step = max(1, -(-(self.high - low + 1) // levels))
        self.levels = (self.high - low) // self.step + 1
        self.level = (self.high - x) // self.step
        self.order = np.argsort(self.level, axis=0, kind="stable")
        self.cuts = np.stack([np.searchsorted(np.sort(column), np.arange(self.levels + 1)) for column in self.level.T])

    def segment(self, dim: int, level: int) -> np.ndarray:
        """Rows of a dimension's posting segment."""
        return self.order[self.cuts[dim, level] : self.cuts[dim, level + 1], dim]

    def caps(self, done: int) -> tuple[int, int]:
        """Greatest component that a row not yet met from above can have, and the least from below, after level `done`."""
        return self.high - (done + 1) * self.step, self.high - (self.levels - 1 - done) * self.step + 1


def search_shard(ids, x, query_ids, q, k: int, limit=None, levels: int = LEVELS):
    """(query_id, vec_id, score) of each query's rows of one shard that may be among its k best, and the postings read and held.

    limit: a score that each query's k-th best reaches anywhere, below every score
    where unknown. Whole numbers in and out; of a query at most k rows come back.
    """
    most = max(1, int(np.abs(x).max())) * max(1, int(np.abs(q).max())) * x.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    never = -np.inf if kind != np.int64 else np.iinfo(np.int64).min // 2
    postings = Postings(x, levels)
    xs = x.astype(kind)
    known = np.full(len(q), never, np.float64 if kind != np.int64 else np.int64)
    if limit is not None:
        known = np.maximum(known, limit)
    found, read = [], 0
    for a in range(0, len(q), BATCH_QUERIES):
        batch = slice(a, a + BATCH_QUERIES)
        read += _search_batch(ids, xs, query_ids[batch], q[batch].astype(kind), known[batch], k, postings, never, found)
    return (*(np.concatenate([f[i] for f in found]) for i in range(3)), read, 2 * x.size * len(q))


def _search_batch(ids, xs, query_ids, qs, known, k: int, postings: Postings, never, found: list) -> int:
    """Search of some queries; sums are rows by queries, so that a posting adds to neighbouring numbers."""
    n, kind = len(xs), xs.dtype
    gain, loss = np.maximum(qs, 0).T.copy(), np.minimum(qs, 0).T.copy()
    active = np.arange(len(qs))
    sums = np.zeros((n, len(qs)), kind)
    read = 0

    def scored(columns: np.ndarray, possible: np.ndarray, exact: np.ndarray | None) -> None:
        c, at = np.nonzero(possible.T)
        s = np.einsum("ij,ij->i", qs[columns[c]], xs[at]) if exact is None else exact[at, c]
        keep = _best(c, s, ids[at], k)
        found.append((query_ids[columns[c[keep]]], ids[at[keep]], s[keep].astype(np.int64)))

    for level in range(postings.levels):
        for dim in range(xs.shape[1]):
            for rows, weight in ((postings.segment(dim, level), gain[dim]), (postings.segment(dim, postings.levels - 1 - level), loss[dim])):
                if len(rows):
                    sums[rows] += xs[rows, dim][:, None] * weight
                    read += len(rows) * len(active)
        if level < postings.levels // 4 or level == postings.levels - 1 or n <= 2 * k:
            continue
        own = query_ids[active][None, :] == ids[:, None]
        top = np.argpartition(np.where(own, never, sums), -k, axis=0)[-k:]  # any k rows give a score that the k-th best reaches
        s = np.where(np.take_along_axis(own, top, 0), never, np.einsum("qd,kqd->kq", qs[active], xs[top]))
        known[active] = np.maximum(known[active], s.min(axis=0))
        high, low = postings.caps(level)
        bound = sums + high * ((postings.level > level).astype(kind) @ gain)
        bound += low * ((postings.level < postings.levels - 1 - level).astype(kind) @ loss)
        possible = (bound >= known[active]) & ~own
        proved = possible.sum(axis=0) <= max(2 * k, n * RESCORED)
        if proved.any():
            scored(active[proved], possible[:, proved], None)
            active, sums, gain, loss = active[~proved], sums[:, ~proved], gain[:, ~proved], loss[:, ~proved]
        if not len(active):
            return read
    own = query_ids[active][None, :] == ids[:, None]
    masked = np.where(own, never, sums)
    least = np.partition(masked, -k, axis=0)[-k] if n > k else np.full(len(active), never)
    scored(active, (masked >= np.maximum(least, known[active])) & ~own, sums)
    return read


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = SCALE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best other rows of each query, exactly."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("is_query")
    ).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    n = vectors.count()
    n_query = vectors.where(is_query).count()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD_ROWS)), max(1, -(-n_query // BLOCK_QUERIES))
    dealt = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    place = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    size = F.size("v").alias("dim")
    candidates = rows.select("vec_id", "v", size, place(shards).alias("shard"), dealt(blocks).alias("block"))
    asked = rows.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.select(F.col("vec_id").alias("asked"), "v", size, place(blocks).alias("block"))

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            ids, query_ids = left.column("vec_id").to_numpy(), right.column("asked").to_numpy()
            x, q = _matrix(left.column("v"), len(ids)), _matrix(right.column("v"), len(query_ids))
            limit = right.column("least").fill_null(np.iinfo(np.int64).min // 2).to_numpy()
            limit = np.where(limit == np.iinfo(np.int64).min // 2, -np.inf, limit) if limit.max() < 1 << 53 else limit
            out = search_shard(ids, x, query_ids, q, k, limit)[:3]
        else:
            out = (np.empty(0, np.int64),) * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), out, strict=True)))

    keys = ("shard", "block", "dim")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(mine, queries: DataFrame) -> DataFrame:
        """The best rows of each query in some of the shards."""
        there = F.array(*[F.lit(i) for i in range(shards) if mine(i)]) if shards <= 64 else F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), mine)
        spread = queries.withColumn("shard", F.explode(there))
        own = candidates.where(mine(F.col("shard")))
        parts = own.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(group, "query_id long, vec_id long, score long")
        return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = written(searched(lambda i: i % SEED_SHARDS == 0, asked.withColumn("least", F.lit(None).cast("long"))), "first-shards")
    least = first.where(F.col("rank") == k).select(F.col("query_id").alias("asked"), F.col("score").alias("least"))
    rest = searched(lambda i: i % SEED_SHARDS != 0, asked.join(least, "asked", "left"))
    best = first.union(rest).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(vectors: DataFrame) -> DataFrame:
    """The 20 best rows of each query, whose ids are the multiples of 20."""
    return top_k(vectors, F.col("vec_id") % QUERY_STEP == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
