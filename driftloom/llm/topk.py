"""Exact top-k search by inner product: ball trees, branch and bound, one tree per shard.

Vectors become integers floor(64 x).  They are dealt to shards by a hash of the row, about
``shard_rows`` each; a shard's ball tree (split along the direction of two far points, leaves of
``LEAF`` vectors, each node with its center and radius) is built once and written.  A node's
bound for a query is  q . center + |q| radius;  queries go through a tree in blocks of ``BLOCK``,
nodes in order of their largest bound over the block, and a node is opened only for the queries
whose bound reaches their k-th best score so far.

The current k-th score is shared between shards: the search goes in waves of 1, 2, 4, ... shards
for each query, beginning at a shard of its own; after each wave the results of all its shards are
merged, and the merged k-th score is the floor that the query takes into the next wave.  Ties are
never cut by a bound.  A task holds one shard's tree and one Arrow batch of queries, however
many queries there are: trees come first in each sorted partition, and queries stream past them.

Scores are exact.  Vectors whose components are small enough for sums of products below 2**52
(all, in practice) are in the tree, in double precision.  The few others, vectors or queries,
are compared by scaled products with an error bound, and what may reach the floor is computed in
Python integers; a large vector never changes how the rest of its shard is searched.  Scores
outside the range of a long saturate to its ends before they are ranked.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows without an id; vectors of another length than a query's are no candidates for it; repeated
ids are candidates each for itself, and only rows with another id than the query's count; an id
that repeats is a query once for each different vector, whose results share the id, and
they are ranked together; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import checkpointed, give_back

K = 20
LEAF = 64
SHARD_ROWS = 8192
BLOCK = 256
TOP = 2**63 - 1
NONE = np.iinfo(np.int64).max


def exact(vector: np.ndarray) -> list[int]:
    """floor(64 x) of doubles of any size as integers."""
    return [int(np.floor(64.0 * x)) if abs(x) < 2.0**52 else 64 * int(x) for x in vector.tolist()]


def small_limit(dim: int) -> float:
    """Vectors with components up to this (after floor(64 x)) have exact products in doubles, whichever two they are."""
    return float(int((2.0**52 / max(dim, 1)) ** 0.5))


def split_small(x: np.ndarray) -> np.ndarray:
    """Which rows of doubles are small: their integers are exact doubles and so are all sums of products of two."""
    return (np.abs(x) * 64.0 + 1.0 <= small_limit(x.shape[1])).all(1) if len(x) else np.zeros(0, bool)


class BallTree:
    """Nodes over integer vectors, which are reordered so that each node is a slice of them."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(points))
        nodes: list[list] = []  # center, radius, from, to, left child, right child
        todo = [(0, len(points), -1, 0)] if len(points) else []
        while todo:
            a, b, parent, side = todo.pop()
            p = points[order[a:b]]
            c = p.mean(0)
            radius = float(np.sqrt(((p - c) ** 2).sum(1).max())) * (1 + 1e-9) + 1e-6
            at = len(nodes)
            nodes.append([c, radius, a, b, -1, -1])
            if parent >= 0:
                nodes[parent][4 + side] = at
            if b - a > leaf and radius > 1e-3:
                far = p[((p - p[0]) ** 2).sum(1).argmax()]
                other = p[((p - far) ** 2).sum(1).argmax()]
                order[a:b] = order[a:b][np.argsort(p @ (far - other), kind="stable")]
                half = a + (b - a) // 2
                todo += [(half, b, at, 1), (a, half, at, 0)]
        self.points, self.ids = points[order], ids[order]
        self.center = np.array([n[0] for n in nodes])
        self.radius = np.array([n[1] for n in nodes])
        self.span = [(n[2], n[3]) for n in nodes]
        self.children = [(n[4], n[5]) for n in nodes]

    def search(self, q: np.ndarray, own: np.ndarray, best: "Best", rows: np.ndarray) -> None:
        """Offers the vectors that may be among the best of the queries (rows of best) to them."""
        if not len(self.center) or not len(q):
            return
        size = np.sqrt((q * q).sum(1))

        def bound(node: int, at: np.ndarray) -> np.ndarray:
            return q[at] @ self.center[node] + size[at] * self.radius[node] + 1e-6 * (1 + size[at])

        heap = [(-float(bound(0, np.arange(len(q))).max()), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            at = np.flatnonzero(bound(node, np.arange(len(q))) >= best.floor[rows])
            if not len(at):
                continue
            left, right = self.children[node]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-float(bound(child, at).max()), child))
                continue
            a, b = self.span[node]
            scores = q[at] @ self.points[a:b].T
            scores[self.ids[None, a:b] == own[at, None]] = -np.inf
            best.offer(rows[at], scores, np.broadcast_to(self.ids[a:b], scores.shape))


class Best:
    """The k best (score, id) of some queries so far, and the score that others must reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.copy()
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), NONE, np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores, ids: one line for each of rows; exact in doubles, -inf for none."""
        scores = np.where(scores >= self.floor[rows, None], scores, -np.inf)
        any_ = (scores > -np.inf).any(1)
        rows, scores, ids = rows[any_], scores[any_], ids[any_]
        if not len(rows):
            return
        s, d = np.concatenate([self.score[rows], scores], 1), np.concatenate([self.id[rows], ids], 1)
        order = np.lexsort((d, -s), axis=1)[:, : self.k]
        s, d = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
        self.score[rows], self.id[rows] = s, d
        self.floor[rows] = np.maximum(self.floor[rows], s[:, -1])


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of doubles as (rows of size 1 at most, exponent of two)."""
    _, e = np.frexp(np.abs(x).max(1, initial=0.0))
    return np.ldexp(x, -e[:, None]), e + 6  # 64 = 2**6


def large_scores(q: np.ndarray, own: int, points: np.ndarray, ids: np.ndarray, floor: float, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best of points (doubles of any size) for one query (doubles), among those that reach floor."""
    keep = ids != own
    points, ids = points[keep], ids[keep]
    if not len(points):
        return []
    (a, ea), (b, eb) = scaled(q[None]), scaled(points)
    about, e = b @ a[0], ea[0] + eb
    # floor() moves each component by less than one: that and the rounding of the sum bound the error.
    dim = len(q)
    with np.errstate(over="ignore"):
        slack = dim * (dim * 2.0**-50 + np.ldexp(1.0, -ea[0]) + np.ldexp(1.0, -eb) + np.ldexp(1.0, -e))
        low, up = np.ldexp(about - slack, e), np.ldexp(about + slack, e)
    low, up = np.clip(low, -(2.0**63), 2.0**63), np.clip(up, -(2.0**63), 2.0**63)
    least = max(floor, np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf)
    qi, out = exact(q), []
    for j in np.flatnonzero(up >= least):
        s = sum(x * y for x, y in zip(qi, exact(points[j])))
        out.append((min(max(s, -TOP - 1), TOP), int(ids[j])))
    return sorted(out, key=lambda t: (-t[0], t[1]))[:k]


class Shard:
    """The vectors of one shard by their length: a tree of the small ones, and the large ones."""

    def __init__(self, ids: np.ndarray, vectors: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """vectors: length -> (places in ids, rows of doubles)."""
        self.trees, self.large = {}, {}
        for dim, (at, x) in vectors.items():
            small = split_small(x)
            self.trees[dim] = BallTree(np.floor(64.0 * x[small]), ids[at[small]])
            self.large[dim] = (x[~small], ids[at[~small]])

    def answers(self, dim: int, q: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, list[int], list[int]]]:
        """(place of the query, scores, ids)."""
        if dim not in self.trees:
            return
        small, tree, (big, big_ids) = split_small(q), self.trees[dim], self.large[dim]
        at = np.flatnonzero(small)
        if len(at):
            best = Best(len(at), k, floors[at])
            z = np.floor(64.0 * q[at])
            for a in range(0, len(at), BLOCK):
                rows = np.arange(a, min(a + BLOCK, len(at)))
                tree.search(z[rows], own[at[rows]], best, rows)
            for i, j in enumerate(at):
                n = int((best.score[i] > -np.inf).sum())
                found = [(int(s), int(d)) for s, d in zip(best.score[i, :n], best.id[i, :n])]
                if len(big):
                    found = sorted(found + large_scores(q[j], int(own[j]), big, big_ids, float(best.floor[i]), k), key=lambda t: (-t[0], t[1]))[:k]
                yield int(j), [s for s, _ in found], [d for _, d in found]
        for j in np.flatnonzero(~small):  # a large query: all vectors by scaled products
            every = np.concatenate([tree.points / 64.0, big]) if len(tree.points) else big
            found = large_scores(q[j], int(own[j]), every, np.concatenate([tree.ids, big_ids]), float(floors[j]), k)
            yield int(j), [s for s, _ in found], [d for _, d in found]


def by_length(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (places, rows) of a column of lists."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return {}
    size = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.cumsum(size) - size
    return {int(d): (at := np.flatnonzero(size == d), flat[first[at][:, None] + np.arange(d)]) for d in np.unique(size)}


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(vectors: DataFrame, k: int = K, every: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the queries (ids divisible by `every`) among vectors (vec_id, embedding)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("_v"), F.coalesce(fine, F.lit(False)).alias("_ok")).where("_ok").drop("_ok")
    shards = max(1, -(-vectors.select("vec_id").count() // shard_rows))
    # The running number keeps many equal rows from one shard; where a row lies doesn't change the result.
    deal = F.pmod(F.xxhash64("vec_id", "_v", F.pmod(F.monotonically_increasing_id(), F.lit(1024))), F.lit(shards)).cast("int")

    def build(table: pa.Table) -> pa.Table:
        shard = Shard(table.column("vec_id").to_numpy(), by_length(table.column("_v")))
        out = pa.table({"_shard": pa.array([table.column("_shard")[0].as_py()], pa.int32()), "_tree": pa.array([pickle.dumps(shard, 5)], pa.binary())})
        del shard
        give_back()
        return out

    trees = checkpointed(rows.withColumn("_shard", deal).groupBy("_shard").applyInArrow(build, "_shard int, _tree binary"))
    trees = trees.select("_shard", F.lit(0).alias("_kind"), "_tree", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("_v"), F.lit(None).cast("double").alias("_floor"))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "_v"])
    queries = queries.withColumn("_home", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, shard = -1, None
        for batch in batches:
            number, kind = batch.column("_shard").to_numpy(), batch.column("_kind").to_numpy()
            a = 0
            while a < batch.num_rows:  # a tree, or a run of queries of one shard
                if kind[a] == 0:
                    here, shard = int(number[a]), None  # the last tree goes before the next comes
                    shard = pickle.loads(batch.column("_tree")[a].as_py())
                    a += 1
                    continue
                b = a + 1
                while b < batch.num_rows and kind[b] and number[b] == number[a]:
                    b += 1
                part, n = batch.slice(a, b - a), b - a
                a = b
                if number[b - 1] != here or shard is None:  # a shard without vectors
                    continue
                own = part.column("vec_id").to_numpy().astype(np.int64)
                floors = part.column("_floor").fill_null(-np.inf).to_numpy(zero_copy_only=False).astype(np.float64)
                out: tuple[list, list, list] = ([], [], [])
                for dim, (at, q) in by_length(part.column("_v")).items():
                    for j, s, d in shard.answers(dim, q, own[at], floors[at], k):
                        out[0].extend([int(own[at[j]])] * len(s))
                        out[1].extend(d)
                        out[2].extend(s)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=FOUND)
        del shard
        give_back()

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best, done, wave = None, 0, 1
    while done < shards:
        n = min(wave, shards - done)
        asked = queries.withColumn("_step", F.explode(F.sequence(F.lit(done), F.lit(done + n - 1))))
        asked = asked.withColumn("_shard", F.pmod(F.col("_home") + F.col("_step"), F.lit(shards)).cast("int"))
        if best is None:
            asked = asked.withColumn("_floor", F.lit(None).cast("double"))
        else:
            # Doubles below a score never cut it: the floor is the next one down where a long isn't exact.
            kth = F.col("_kth").cast("double")
            low = kth - F.when(F.abs(kth) >= 2.0**52, F.abs(kth) * 2.0**-50).otherwise(0.0)
            floors = best.groupBy(F.col("query_id").alias("_q")).agg(F.count("*").alias("_n"), F.min("score").alias("_kth"))
            floors = floors.select("_q", F.when(F.col("_n") >= k, low).alias("_floor"))
            asked = asked.join(floors, asked["vec_id"] == F.col("_q"), "left")
        asked = asked.select("_shard", F.lit(1).alias("_kind"), F.lit(None).cast("binary").alias("_tree"), "vec_id", "_v", "_floor")
        parts = max(1, min(shards, 20_000))
        dealt = trees.union(asked).repartition(parts, "_shard").sortWithinPartitions("_shard", "_kind")
        found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
        merged = found if best is None else best.union(found)
        best = merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        done, wave = done + n, 2 * wave
        if done < shards:
            best = checkpointed(best.select("query_id", "vec_id", "score"))
    return best.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
