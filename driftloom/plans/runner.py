"""The run matrix: every (method, seed, variant) is one ordered state machine, so runs are the unit of parallelism.

The stream is dealt to the runs' partitions, sorted by t, and streams through a task in Arrow
batches; a task holds a run's state, one batch and the rows of an unfinished chunk (at the start, of the
calibration prefix), never the stream.  `run_matrix` emits a trace row for each observation and,
at chunk ends, snapshot rows.  Evaluation is apart from learning: `evaluate` clusters each snapshot,
assigns the chunk's rows to the centers and scores the partition with DataFrame aggregates.
Labels never reach a kernel.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import StreamConfig, study
from ..kernels.kmeans import assign, weighted_kmeans
from ..kernels.methods import AdaptiveMethod, build
from ..operators.quality import partition_quality
from ..operators.vectors import as_lists, rows_of
from ..session import checkpointed

CALIBRATION = 1000
GROWING = ("fra_art",)  # methods whose summary grows with the stream; it's the mean of the rows of each category
SLICES = 32  # of the chunks of such a run, scored side by side


def run_cells(spark: SparkSession, cells: list[tuple[str, int, str, dict]]) -> DataFrame:
    """(method, seed, variant, parameters) of each run, as a table with a number for each."""
    rows = [(i, m, int(s), v, json.dumps(p)) for i, (m, s, v, p) in enumerate(cells)]
    return spark.createDataFrame(rows, "run int, method string, seed int, variant string, params string")


class Chunk(NamedTuple):
    """What a run has learned up to the end of a chunk: its rows in the method's space, their steps, and the summary."""

    number: int
    t: np.ndarray
    z: np.ndarray
    steps: list
    centers: np.ndarray
    weights: np.ndarray
    basis: np.ndarray | None


class Run:
    """One run over rows that come in order, in pieces of any size."""

    def __init__(self, method: str, seed: int, params: dict, chunk: int, calibration: int = CALIBRATION, shots: bool = True) -> None:
        self.shots = shots  # else chunks come without a summary, which may be large, and `model` has the last one
        self.method, self.seed, self.params, self.chunk, self.calibration = method, seed, dict(params), chunk, calibration
        self.width = self.params.pop("features", None)
        self.t, self.x, self.number = np.empty(0, np.int64), np.empty((0, 0)), 0
        self.model, self.view = None, None

    def _begin(self) -> None:
        width, cfg = self.x.shape[1], None
        if self.method in ("proposed", "fixed_rank"):
            cfg = StreamConfig.flat(**(study(width, self.seed) | self.params | (study(width, self.seed, True) if self.method == "fixed_rank" else {})))
        self.model, self.view = build(self.method, width, self.seed, cfg, float(self.params.get("radius", 1.5)), self.x[: self.calibration])

    def _learn(self, n: int) -> Chunk:
        t, x = self.t[:n], self.x[:n]
        self.t, self.x = self.t[n:], self.x[n:]
        z = self.view(x)
        steps, basis = self.model.learn_all(z), None
        self.placed = steps  # of methods in GROWING, the category of each row
        if isinstance(self.model, AdaptiveMethod):  # only the adaptive ones tell of their steps
            basis = self.model.basis()
        else:
            steps = []
        self.number += 1
        shot = self.model.snapshot() if self.shots else (np.empty((0, z.shape[1])), np.empty(0))
        return Chunk(self.number - 1, t, z, steps, *shot, None if basis is None else basis.copy())

    def feed(self, t: np.ndarray, x: np.ndarray, last: bool = False) -> Iterator[Chunk]:
        """The chunks that these rows complete; with `last`, all that is left."""
        x = np.asarray(x, np.float64)[:, : self.width]
        self.t, self.x = np.concatenate([self.t, t]), np.concatenate([self.x, x]) if len(self.x) else x
        if self.model is None:
            if not len(self.x) or (len(self.x) < self.calibration and not last):
                return
            self._begin()
        while len(self.x) >= self.chunk or (last and len(self.x)):
            yield self._learn(min(self.chunk, len(self.x)))


def learn(x: np.ndarray, t: np.ndarray, method: str, seed: int, params: dict, chunk: int, calibration: int = CALIBRATION):
    """A whole run in memory: (steps, snapshots (chunk, centers, weights, basis), counters, rows in the method's space)."""
    run = Run(method, seed, params, chunk, calibration)
    done = list(run.feed(t, x, last=True))
    shots = [(c.number, c.centers, c.weights, c.basis) for c in done]
    return [s for c in done for s in c.steps], shots, run.model.counters(), np.concatenate([c.z for c in done])


def over_runs(stream: DataFrame, cells: DataFrame, chunk: int, schema: pa.Schema, ddl: str, emit, shots: bool = True) -> DataFrame:
    """The rows that emit(cell) makes of each run: an object with .chunk(run, chunk) and .end(run), which yield column dictionaries.

    Without shots, chunks have no summaries.
    """
    plan = {r["run"]: r for r in cells.collect()}  # a grid written out in code
    numbers = F.array(*[F.lit(i) for i in plan]) if plan else F.array().cast("array<int>")
    runs = stream.select(F.col("t").cast("long").alias("t"), F.transform("features", lambda v: v.cast("double")).alias("features"), F.explode(numbers).alias("run"))
    runs = runs.repartition(max(1, 4 * len(plan)), "run").sortWithinPartitions("run", "t")

    def table(cell, columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        every = {"method": [cell["method"]] * n, "seed": [cell["seed"]] * n, "variant": [cell["variant"]] * n} | columns
        every = {k: v if isinstance(v, pa.Array) else pa.array(v, schema.field(k).type) for k, v in every.items() if k in schema.names}
        return pa.RecordBatch.from_arrays([every[f.name] if f.name in every else pa.nulls(n, f.type) for f in schema], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, run, out = None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            if run is not None:
                for c in run.feed(np.empty(0, np.int64), np.empty((0, run.x.shape[1])), last=True):
                    yield from (table(plan[at], d) for d in out.chunk(run, c))
                yield from (table(plan[at], d) for d in out.end(run))

        for batch in batches:
            number, t = batch.column("run").to_numpy(), batch.column("t").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if number[a] != at:
                    yield from close()
                    at = int(number[a])
                    cell = plan[at]
                    run, out = Run(cell["method"], cell["seed"], json.loads(cell["params"]), chunk, shots=shots), emit(cell)
                for c in run.feed(t[a:b], rows_of(batch.slice(a, b - a))):
                    yield from (table(plan[at], d) for d in out.chunk(run, c))
        yield from close()

    return runs.mapInArrow(work, ddl)


TRACE = (
    "kind string, method string, seed int, variant string, t long, chunk long, mc_id long, rank int, leverage double, prob double, accepted boolean, "
    "error double, threshold double, updated boolean, rank_changed boolean, candidate_rank int, center_ix int, center array<double>, weight double, counters string"
)
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ddl.split(", ")])


STEP = ("rank", "leverage", "prob", "accepted", "error", "threshold", "updated", "rank_changed", "candidate_rank")


class Told:
    """Trace rows of the adaptive methods, snapshot rows and a final row of counters."""

    def __init__(self, cell, kinds: tuple[str, ...] = ("step", "center", "basis", "final")) -> None:
        self.kinds = kinds

    def chunk(self, run: Run, c: Chunk) -> Iterator[dict]:
        if c.steps and "step" in self.kinds:
            n = len(c.steps)
            columns = {name: [getattr(s, name) for _, s in c.steps] for name in STEP}
            yield {"kind": ["step"] * n, "t": c.t, "chunk": [c.number] * n, "mc_id": [mc for mc, _ in c.steps]} | columns
        n = len(c.centers)
        if n and "center" in self.kinds:
            yield {"kind": ["center"] * n, "chunk": [c.number] * n, "center_ix": range(n), "center": c.centers.tolist(), "weight": c.weights.tolist()}
        if c.basis is not None and "basis" in self.kinds:
            n = c.basis.shape[1]
            yield {"kind": ["basis"] * n, "chunk": [c.number] * n, "center_ix": range(n), "center": c.basis.T.tolist()}

    def end(self, run: Run) -> Iterator[dict]:
        if "final" in self.kinds:
            yield {"kind": ["final"], "counters": [json.dumps({k: int(v) for k, v in run.model.counters().items()}, sort_keys=True)]}


def run_matrix(stream: DataFrame, cells: DataFrame, chunk: int = 1000, kinds: tuple[str, ...] = ("step", "center", "basis", "final")) -> DataFrame:
    """stream: (t, features).  Trace rows of the adaptive methods, snapshot rows and a final row of counters for all; those of `kinds` only."""
    return over_runs(stream, cells, chunk, arrow_schema(TRACE), TRACE, lambda cell: Told(cell, kinds), shots="center" in kinds)


PLACED = "method string, seed int, variant string, slice int, task int, chunk long, t long, place long, z array<double>, n double"
PREDICTED = "method string, seed int, variant string, chunk long, t long, pred int"
FINAL = "method string, seed int, variant string, model binary"


def labels_of(z: np.ndarray, basis: np.ndarray | None, centers: np.ndarray) -> np.ndarray:
    """Nearest center of rows that went through single precision, as stored representations do."""
    z = z.astype(np.float32).astype(np.float64)
    return assign(z if basis is None else (z @ basis) @ basis.T, centers).astype(np.int32)


def predictions(stream: DataFrame, cells: DataFrame, classes: int, chunk: int = 1000, starts: int = 1, steps: int = 20, warmup: int = 1, final: bool = False) -> DataFrame:
    """Deferred evaluation: the labels that k-means of the snapshot at a chunk's end gives the chunk's rows.

    The first `warmup` chunks of a longer stream aren't scored.  With `final`, the last snapshot labels all rows
    instead (chunk -1): the runs' last models, a few centers each, are collected, and every row is labelled where it lies.
    """

    class Scored:
        def __init__(self, cell) -> None:
            self.held: list[dict] | None = []

        def chunk(self, run: Run, c: Chunk) -> Iterator[dict]:
            row = {"chunk": [c.number] * len(c.t), "t": c.t, "pred": labels_of(c.z, c.basis, weighted_kmeans(c.centers, c.weights, classes, run.seed, starts, steps))}
            if c.number < warmup:
                self.held.append(row)
            else:
                self.held = None
                yield row

        def end(self, run: Run) -> Iterator[dict]:
            yield from self.held or []

    class Last:
        def __init__(self, cell) -> None:
            self.last: Chunk | None = None

        def chunk(self, run: Run, c: Chunk) -> Iterator[dict]:
            self.last = c
            return iter(())

        def end(self, run: Run) -> Iterator[dict]:
            shot = weighted_kmeans(*run.model.snapshot(), classes, run.seed, starts, steps)
            yield {"model": [pickle.dumps((run.width, run.view, self.last.basis, shot))]}

    if not final:
        rest, growing = cells.where(~F.col("method").isin(*GROWING)), cells.where(F.col("method").isin(*GROWING))
        scored = over_runs(stream, rest, chunk, arrow_schema(PREDICTED), PREDICTED, Scored)
        if growing.isEmpty():
            return scored
        apart = scored_apart(stream, growing, classes, chunk, starts, steps, warmup)
        return apart if rest.isEmpty() else scored.unionByName(apart)
    models = [(r["method"], r["seed"], r["variant"], pickle.loads(r["model"])) for r in over_runs(stream, cells, chunk, arrow_schema(FINAL), FINAL, Last, shots=False).collect()]
    shared, schema = stream.sparkSession.sparkContext.broadcast(models), arrow_schema(PREDICTED)  # a basis and `classes` centers for each run

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, n = rows_of(batch), batch.num_rows
                for method, seed, variant, (width, view, basis, c) in shared.value:
                    columns = ([method] * n, [seed] * n, [variant] * n, [-1] * n, batch.column("t"), labels_of(view(x[:, :width]), basis, c))
                    yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(columns, schema)], schema=schema)

    return stream.select(F.col("t").cast("long").alias("t"), "features").mapInArrow(label, PREDICTED)


def scored_apart(stream: DataFrame, cells: DataFrame, classes: int, chunk: int, starts: int, steps: int, warmup: int, slices: int = SLICES) -> DataFrame:
    """`predictions` of methods in GROWING: one task learns a run and tells the category of each row, then slices of the chunks are scored side by side.

    At the end of a chunk the summary is a sum and a number of rows for each category, so a slice needs those of its beginning, which the
    learning task writes, and its own rows.  The last chunk's k-means costs most, so slices get shorter: their work is about the same,
    and each has a task of its own.
    """
    many = -(-stream.count() // chunk)
    edges = np.unique(np.ceil(many * np.sqrt(np.arange(slices) / slices)).astype(np.int64))
    first = {r["run"]: i * len(edges) for i, r in enumerate(cells.collect())}

    class Placed:
        def __init__(self, cell) -> None:
            self.first = first[cell["run"]]

        def chunk(self, run: Run, c: Chunk) -> Iterator[dict]:
            part, n = int(np.searchsorted(edges, c.number, side="right")) - 1, len(c.t)
            yield {"slice": [part] * n, "task": [self.first + part] * n, "chunk": [c.number] * n, "t": c.t, "place": run.placed, "z": as_lists(c.z)}
            if c.number + 1 in edges[1:]:
                for a in range(0, run.model.n, 4096):
                    b = min(a + 4096, run.model.n)
                    yield {"slice": [part + 1] * (b - a), "task": [self.first + part + 1] * (b - a), "place": np.arange(a, b), "z": as_lists(run.model.total[a:b]), "n": run.model.count[a:b]}

        def end(self, run: Run) -> Iterator[dict]:
            return iter(())

    by = ["method", "seed", "variant", "slice"]
    placed = over_runs(stream, cells, chunk, arrow_schema(PLACED), PLACED, Placed, shots=False)
    placed = placed.repartitionById(max(1, len(first) * len(edges)), "task").sortWithinPartitions(*by, F.col("t").asc_nulls_first(), "place")
    schema = arrow_schema(PREDICTED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by slice, those of its beginning first; the rows of a chunk are held until the next one begins."""
        at, number, held, total, count = None, None, [], None, None

        def grown(n: int, width: int) -> None:
            nonlocal total, count
            if total is None or n > len(count):
                more = np.zeros((max(n, 2 * len(count) if count is not None else 1024), width)), np.zeros(max(n, 2 * len(count) if count is not None else 1024))
                if total is not None:
                    more[0][: len(count)], more[1][: len(count)] = total, count
                total, count = more

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t, place, z = (np.concatenate(x) for x in zip(*held))
            held.clear()
            grown(int(place.max()) + 1, z.shape[1])
            np.add.at(total, place, z)  # in order, as the method adds
            np.add.at(count, place, 1.0)
            if number >= warmup or many <= warmup:
                m, n = int(count.astype(bool).sum()), len(t)
                found = weighted_kmeans(total[:m] / np.maximum(count[:m, None], 1e-12), count[:m], classes, at[1], starts, steps)
                columns = ([at[0]] * n, [at[1]] * n, [at[2]] * n, [number] * n, t, labels_of(z, None, found))
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*by, "chunk"))))
            place, n = batch.column("place").to_numpy(), batch.column("n").to_numpy(zero_copy_only=False)
            t, z = batch.column("t").to_numpy(zero_copy_only=False), rows_of(batch, "z")
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != (at and (*at, number)):
                    yield from close()
                    if keys[a][:4] != at:
                        total, count = None, None
                    at, number = keys[a][:4], keys[a][4]
                if number is None:
                    grown(int(place[a:b].max()) + 1, z.shape[1])
                    total[place[a:b]], count[place[a:b]] = z[a:b], n[a:b]
                else:
                    held.append((t[a:b].astype(np.int64), place[a:b], z[a:b]))
        yield from close()

    return placed.mapInArrow(work, PREDICTED)


def with_labels(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """predicted (t, ...) with the label of each row; a row without a label raises, as rows and labels are a pair."""
    known = labels.select(F.col("t").alias("_t"), F.col("label").cast("long").alias("_label"))
    missing = F.raise_error(F.concat(F.lit("no label for the row with t = "), F.col("t").cast("string"))).cast("long")
    return predicted.join(known, F.col("t") == F.col("_t"), "left").withColumn("label", F.coalesce("_label", missing)).drop("_t", "_label")


def evaluate(stream: DataFrame, cells: DataFrame, classes: int, chunk: int = 1000, **how) -> DataFrame:
    """method, seed, variant, chunk, n, ari, nmi: predictions joined with the labels, which no kernel has seen."""
    stream = checkpointed(stream)  # learning, scoring and labels read it
    scored = with_labels(predictions(stream, cells, classes, chunk, **how), stream.select("t", "label"))
    return partition_quality(scored, ["method", "seed", "variant", "chunk"], "label", "pred")
