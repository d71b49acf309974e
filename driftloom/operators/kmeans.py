"""Weighted k-means over a table: seeding by oversampled rounds, Lloyd steps, and all starts in each pass.

A pass reads the rows once, in Arrow batches, for every start that still moves; a task sends one row for each center.
What the driver holds is centers: at most ``starts * k`` of them, and while seeding the candidates, about
``starts * (1 + rounds * oversample)``; both are checked against ``MOST_CELLS`` numbers.  Random numbers are hashes of t, start and round, so the
result doesn't depend on how rows lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.kmeans import LEAST_WEIGHT, STILL, squared, weighted_kmeans
from .vectors import as_lists, rows_of

MOST_CELLS = 20_000_000


def uniform(t: np.ndarray, *keys: int) -> np.ndarray:
    """A number in 0..1 (never 0) from each t and some keys."""
    x = t.astype(np.uint64)
    for key in (*keys, 0x5851F42D):
        x = (x ^ np.uint64((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """t, features and weights of each batch with rows."""
    for b in batches:
        if b.num_rows:
            w = np.maximum(b.column("w").to_numpy(zero_copy_only=False).astype(np.float64), LEAST_WEIGHT)
            yield b.column("t").to_numpy(zero_copy_only=False), rows_of(b), w


def _pass(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return rows.select("t", "features", "w").mapInArrow(run, schema)


def _first(rows: DataFrame, starts: int, seed: int) -> list[np.ndarray]:
    """A row for each start, drawn in proportion to weight: the least exponential key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple | None] = [None] * starts
        for t, x, w in _batches(batches):
            for s in range(starts):
                key = -np.log(uniform(t, seed, s)) / w
                i = int(np.lexsort((t, key))[0])
                if best[s] is None or (key[i], t[i]) < best[s][:2]:
                    best[s] = (float(key[i]), int(t[i]), x[i].copy())
        if best and best[0] is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(starts), pa.int32()), pa.array([b[0] for b in best]), pa.array([b[1] for b in best]), as_lists(np.stack([b[2] for b in best]))], ["start", "key", "t", "x"])

    kept = _pass(rows, run, "start int, key double, t long, x array<double>").groupBy("start").agg(F.min(F.struct("key", "t", "x")).alias("b"))
    return [np.array([r.b.x]) for r in sorted(kept.collect(), key=lambda r: r.start)]


def _costs(rows: DataFrame, centers: list[np.ndarray]) -> list[float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centers))
        for _, x, w in _batches(batches):
            total += [w @ squared(x, c).min(1) for c in centers]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["start", "cost"])

    told = {r.start: r.cost for r in _pass(rows, run, "start int, cost double").groupBy("start").agg(F.sum("cost").alias("cost")).collect()}
    return [told.get(s, 0.0) for s in range(len(centers))]


def _oversampled(rows: DataFrame, centers: list[np.ndarray], costs: list[float], much: int, seed: int, turn: int) -> list[np.ndarray]:
    """Rows drawn, each by itself, in proportion to weight times squared distance; about ``much`` for each start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, x, w in _batches(batches):
            for s, c in enumerate(centers):
                at = np.flatnonzero(uniform(t, seed, s, turn + 1) * costs[s] < much * w * squared(x, c).min(1)) if costs[s] > 0 else []
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(t[at]), as_lists(x[at])], ["start", "t", "x"])

    drawn: list[list] = [[] for _ in centers]
    for r in _pass(rows, run, "start int, t long, x array<double>").orderBy("start", "t").collect():
        drawn[r.start].append(r.x)
    return [np.concatenate([c, np.array(d)]) if d else c for c, d in zip(centers, drawn)]


def step(rows: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each start, the weighted sums and masses of its centers' rows and the cost, in one pass over all rows."""
    names = sorted(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {s: np.zeros((len(centers[s]), centers[s].shape[1] + 2)) for s in names}
        for _, x, w in _batches(batches):
            wide = np.concatenate([x * w[:, None], w[:, None]], 1)
            for s in names:
                d2 = squared(x, centers[s])
                own = d2.argmin(1)
                order = np.argsort(own, kind="stable")
                found, first = np.unique(own[order], return_index=True)
                sums[s][found, :-1] += np.add.reduceat(wide[order], first)
                sums[s][0, -1] += w @ d2[np.arange(len(own)), own]
        for s in names:
            n = len(sums[s])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s, np.int32)), pa.array(np.arange(n, dtype=np.int32)), as_lists(sums[s])], ["start", "center", "sums"])

    cells = _pass(rows, run, "start int, center int, sums array<double>").select("start", "center", F.posexplode("sums").alias("dim", "s"))
    out = {s: np.zeros((len(centers[s]), centers[s].shape[1] + 2)) for s in names}
    for r in cells.groupBy("start", "center", "dim").agg(F.sum("s").alias("s")).collect():
        out[r.start][r.center, r.dim] = r.s
    return {s: (m[:, :-2], m[:, -2], float(m[:, -1].sum())) for s, m in out.items()}


def seeds(rows: DataFrame, k: int, seed: int, starts: int, rounds: int = 5, oversample: int | None = None) -> list[np.ndarray]:
    """k centers for each start: candidates by oversampled rounds, weighted by the rows nearest to them, clustered where they lie."""
    found = _first(rows, starts, seed)
    if not found:
        return []
    much = oversample or 2 * k
    if starts * (1 + 2 * rounds * much) * found[0].shape[1] > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} numbers of candidates: take fewer starts at a time")
    for turn in range(rounds):
        found = _oversampled(rows, found, _costs(rows, found), much, seed, turn)
    mass = step(rows, dict(enumerate(found)))
    return [weighted_kmeans(c, mass[s][1], k, seed + s, starts=10, steps=100) for s, c in enumerate(found)]


def table_kmeans(rows: DataFrame, k: int, seed: int, starts: int = 10, steps: int = 300, rounds: int = 5, initial: list[np.ndarray] | None = None) -> tuple[np.ndarray, float] | None:
    """Centers and cost of the best start over rows (t, features, w); None for an empty table.

    A start stops when its centers' squared shift is no more than the published limit; a center without rows stays.
    Weights count at least a tiny mass; rows with null features raise.
    """
    centers = dict(enumerate(seeds(rows, k, seed, starts, rounds) if initial is None else initial))
    moving, cost = set(centers), {}
    for _ in range(steps):
        if not moving:
            break
        for s, (sums, mass, _) in step(rows, {s: centers[s] for s in moving}).items():
            moved = np.divide(sums, mass[:, None], out=centers[s].copy(), where=mass[:, None] > 0)
            if ((moved - centers[s]) ** 2).sum() <= STILL:
                moving.discard(s)
            centers[s] = moved
    cost = {s: c for s, (_, _, c) in step(rows, centers).items()} if centers else {}
    best = min(cost, key=lambda s: (cost[s], s), default=None)
    return None if best is None else (centers[best], cost[best])
