"""Exact top-k inner-product search with ball trees.

Each task builds a ball tree over at most ``SHARD`` of its vectors at a time: a node has a center and the
radius of the ball around it that holds its vectors, so q.center + |q| * radius bounds the inner product of
q with all of them. A query goes through a shard's leaves from the highest bound down and stops at the
first whose bound is below its current k-th score; bounds of inner nodes drop whole subtrees before. The
k-th score is carried from leaf to leaf, from shard to shard of a task, and, by way of a first search over
a small fixed part of the vectors, to all tasks.

Vectors are quantised to floor(scale * x), so scores are exact integers and ties are real: they go to the
smaller vec_id. Bounds are rounded up by more than their floating-point error. Products that doubles don't hold
exactly are summed as integers of any size.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part; vectors of
different lengths are never compared; components saturate at the bounds of long and scores at ``LIMIT``; a null vec_id is no query and no candidate; rows that repeat a vec_id
are candidates each (but not for the query of that vec_id) and one query, the smallest of its vectors; fewer than k candidates give all;
an empty table gives an empty result; extra columns are not read.

Scale: the quantised vectors are stored once; one pass over them per block of ``QUERY_BLOCK`` queries, whose
size bounds what is broadcast; a task sends at most k rows a query, and only scores that reach the shared k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

SHARD, LEAF = 8_192, 128
#: Queries that are broadcast at once (8 bytes a component).
QUERY_BLOCK = 16_384
#: About so many vectors are searched first for the shared k-th score. Any number gives the same result.
SEED_ROWS = 4_096

#: Scores saturate here; NONE stands for no score, and its negation exists.
LIMIT = 1 << 62
NONE = -LIMIT - 1

FOUND = "query_id long, vec_id long, score long"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    # JSON-like special values: comparisons with NaN hold in Spark, so each kind is tested by name.
    whole = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


class BallTree:
    """Leaves are runs of the reordered vectors; nodes are listed level by level, leaves last."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.arange(len(ids))
        cuts = [(0, len(ids))]
        self.levels: list[np.ndarray] = []
        while True:
            self.levels.append(np.array(cuts))
            if max(b - a for a, b in cuts) <= LEAF:
                break
            split = []
            for a, b in cuts:
                own = v[order[a:b]]
                # towards the vector farthest from the center, and from the one farthest from that
                p = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                q = own[((own - p) ** 2).sum(axis=1).argmax()]
                side = np.argsort(own @ (q - p), kind="stable")
                order[a:b] = order[a:b][side]
                split += [(a, (a + b) // 2), ((a + b) // 2, b)]
            cuts = split
        self.ids, self.v, self.order = ids[order], v[order], order
        self.balls = []
        for level in self.levels:
            centers = np.array([self.v[a:b].mean(axis=0) for a, b in level])
            radii = np.array([np.sqrt(((self.v[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(level, centers, strict=True)])
            self.balls.append((centers, radii))


class Best:
    """The k best of each query so far, in order; shared k-th scores start it."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.score = np.full((queries, k), NONE)
        self.ids = np.full((queries, k), -NONE)

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.least)

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate((self.score[which], score), axis=1)
        i = np.concatenate((self.ids[which], np.broadcast_to(ids, score.shape)), axis=1)
        if s.shape[1] > 3 * self.k:  # all that reach the k-th score, then the exact order
            kth = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            most = int((s >= kth).sum(axis=1).max())
            near = np.argsort(-s, axis=1, kind="stable")[:, :most]
            s, i = np.take_along_axis(s, near, 1), np.take_along_axis(i, near, 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[which], self.ids[which] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(tree: BallTree, q_ids: np.ndarray, q: np.ndarray, best: Best, whole: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """Branch and bound; returns the number of (query, leaf) visits. whole: the queries and the tree's vectors as integers, where doubles may not hold them."""
    norms, alive, visits = np.sqrt((q**2).sum(axis=1)), np.ones((len(q), 1), bool), 0
    for centers, radii in tree.balls:  # down the tree: a child lives while its parent and its own bound reach the k-th score
        if len(radii) != alive.shape[1]:
            alive = np.repeat(alive, 2, axis=1)
        product = q @ centers.T
        bound = product + norms[:, None] * radii
        bound += 1e-9 * (np.abs(bound) + norms[:, None] * np.sqrt((centers**2).sum(axis=1))) + 1e-6
        alive &= bound >= best.kth()[:, None]
    bound[~alive] = -np.inf
    turn = np.argsort(-bound, axis=1)
    active = np.flatnonzero(alive.any(axis=1))
    leaves = tree.levels[-1]
    small = float(np.abs(q).max(initial=0)) * float(np.abs(tree.v).max(initial=0)) * max(1, q.shape[1]) < 2**53
    for step in range(turn.shape[1]):
        leaf = turn[active, step]
        go = bound[active, leaf] >= best.kth()[active]
        go &= np.isfinite(bound[active, leaf])
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        visits += len(active)
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[order])) + 1
        for own in np.split(order, cuts):
            which, (a, b) = active[own], leaves[leaf[own[0]]]
            if small:
                score = (q[which] @ tree.v[a:b].T).astype(np.int64)
            else:
                us, ws = (whole[0][which].tolist(), whole[1][tree.order[a:b]].tolist()) if whole else (q[which].astype(np.int64).tolist(), tree.v[a:b].astype(np.int64).tolist())
                score = np.array([[max(-LIMIT, min(LIMIT, sum(x * y for x, y in zip(u, w, strict=True)))) for w in ws] for u in us], dtype=np.int64)
            score[q_ids[which][:, None] == tree.ids[a:b]] = NONE
            best.add(which, score, tree.ids[a:b])
    return visits


def _searched(vectors: DataFrame, queries: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> DataFrame:
    """The k best per query and task (FOUND) of vectors of the queries' length."""
    sent = vectors.sparkSession.sparkContext.broadcast(queries)
    size = queries[1].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, exact, least = sent.value
        best = Best(len(exact), k, least)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(all_too: bool) -> None:
            while held and (all_too or sum(len(x) for x, _ in held) >= SHARD):
                ids, v = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
                held.clear()
                if len(ids) > SHARD:
                    held.append((ids[SHARD:], v[SHARD:]))
                search(BallTree(ids[:SHARD], v[:SHARD].astype(np.float64)), q_ids, exact.astype(np.float64), best, (exact, v[:SHARD]))

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, size)))
                flush(False)
        flush(True)
        some = (best.score > NONE) & (best.score >= least[:, None])
        which, _ = np.nonzero(some)
        for i in range(0, len(which), 50_000):
            part = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[which[part]]), pa.array(best.ids[some][part]), pa.array(best.score[some][part])], schema=_FOUND)

    return vectors.filter(F.size("v") == size).mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score); both tables have (vec_id long, v array<long>)."""
    spark = vectors.sparkSession
    vectors, _ = stored(vectors, "vectors")
    queries, _ = stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    totals = {r["size"]: r["n"] for r in vectors.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    counted = queries.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per length
    out = None
    for r in sorted(counted, key=lambda r: r["size"]):
        n_blocks = -(-r["n"] // QUERY_BLOCK)
        for b in range(n_blocks):
            own = queries.filter((F.size("v") == r["size"]) & (F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b)).toArrow()
            if not own.num_rows:
                continue
            ids = own["vec_id"].to_numpy()
            q = own["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), r["size"])
            least = np.full(len(ids), NONE)
            total = totals.get(r["size"], 0)
            if total > 2 * SEED_ROWS:
                part = vectors.filter(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(total // SEED_ROWS)) == 0).coalesce(8)
                first = _ranked(_searched(part, (ids, q, least), k), k).filter(F.col("rank") == k).select("query_id", "score").toArrow()
                order = np.argsort(ids)
                least[order[np.searchsorted(ids[order], first["query_id"].to_numpy())]] = first["score"].to_numpy()
            found = _ranked(_searched(vectors, (ids, q, least), k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op6_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE)))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
