"""Registered queries that run the order-dependent kernels.  SQL expresses some state machines step by step; tests compare the rest with slow models and published values."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ABLATION, SEEDS, clamped, sensitivity_cells
from ..kernels.methods import METHODS, REGISTRY, View
from ..kernels.summaries import MicroClusters, Resonance
from ..operators import traces, vectors
from ..sources import tables
from ..sources.controlled import controlled_stream as generated
from ..sources.controlled import read_controlled
from ..streaming.stateful import drain, learn_stream, stream_files
from . import runner

PARAMS = {"projection_dim": 32, "window_size": 256, "microcluster_radius": 1.5}
CHUNK = 100
BATCH = 50_000  # rows of a micro-batch, about


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector stream, causally standardized."""
    s = tables.embeddings(spark, sf_dir)
    z = vectors.causal_standardize(vectors.melt(s)).groupBy("t").agg(F.sort_array(F.collect_list(F.struct("dim", "z"))).alias("c"))
    return z.select("t", F.transform("c", lambda x: x["z"]).alias("features")).join(s.select("t", "label"), "t")


def _cells(spark: SparkSession, seeds: tuple[int, ...] = (7, 13)) -> DataFrame:
    return runner.run_cells(spark, [(m, s, "study", PARAMS if m in ("proposed", "fixed_rank") else {"radius": 8.0}) for m in METHODS for s in seeds])


def all_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality of each of the seven methods over two seeds."""
    q = runner.evaluate(_stream(spark, sf_dir), _cells(spark), 10, CHUNK)
    return q.groupBy("method", "seed").agg(F.count("*").alias("chunks"), F.avg("ari").alias("ari"), F.avg("nmi").alias("nmi"))


def final_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition of the whole stream by the last summary of each method."""
    return runner.evaluate(_stream(spark, sf_dir), _cells(spark, (7,)), 10, CHUNK, final=True).select("method", "seed", "n", "ari", "nmi")


def all_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window scored, with ten starts of k-means."""
    cells = runner.run_cells(spark, [(m, 7, "windows", {"radius": 8.0}) for m in ("twstream", "fra_art")])
    return runner.evaluate(_stream(spark, sf_dir), cells, 10, CHUNK, warmup=0, starts=10, steps=300)


def proposed_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = runner.run_cells(spark, [("proposed", s, "study", PARAMS) for s in (7, 13)])
    steps = runner.run_matrix(_stream(spark, sf_dir), cells, CHUNK, ("step",))
    return steps.select("seed", "t", "chunk", "mc_id", "rank", "leverage", "prob", "accepted", "error", "threshold", "updated", "rank_changed", "candidate_rank")


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank telemetry and admission of the ablation's variants."""
    cells = runner.run_cells(spark, [("proposed", 7, v, PARAMS | p) for v, p in ABLATION.items()])
    steps = runner.run_matrix(_stream(spark, sf_dir), cells, CHUNK, ("step",))
    told = traces.telemetry(steps, ["variant"]).select("variant", "rank_mean", "rank_changes")
    return told.join(steps.groupBy("variant").agg(F.avg(F.col("accepted").cast("double")).alias("admitted")), "variant")


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each value of some axes of the vector table, whose width and length are below the study's."""
    axes = {"features": (16, 32, 64), "projection_dim": (16, 32), "window_size": (64, 256), "max_rank": (8, 16), "max_microclusters": (50, 200)}
    cells = []
    for axis, points in axes.items():
        for v in points:
            p = clamped(PARAMS | {axis: v})
            cells.append(("proposed", 7, f"{axis}={v}", p))
    q = runner.evaluate(_stream(spark, sf_dir), runner.run_cells(spark, cells), 10, CHUNK)
    return q.groupBy("variant").agg(F.avg("ari").alias("ari"), F.avg("nmi").alias("nmi"))


def controlled_stream(spark: SparkSession) -> DataFrame:
    """The generated drift stream at its full size, standardized."""
    return read_controlled(spark, slices=4, standardized=True)


def sensitivity_grid(spark: SparkSession, seed: int = 7) -> DataFrame:
    """The study's grid on the controlled stream: five axes of three values each."""
    cells = [("proposed", seed, f"{axis}={v}", p | {"features": p.pop("original_dim")}) for axis, v, p in sensitivity_cells({"original_dim": 256})]
    q = runner.evaluate(controlled_stream(spark), runner.run_cells(spark, cells), 4, 1000, starts=10, steps=300)
    return q.groupBy("variant").agg(F.count("*").alias("chunks"), F.avg("ari").alias("ari"), F.avg("nmi").alias("nmi"))


def controlled_trace(spark: SparkSession, seeds: tuple[int, ...], variants: dict[str, dict]) -> DataFrame:
    """Steps of the adaptive method on the controlled stream; t counts from 1, as the study's traces do."""
    cells = runner.run_cells(spark, [("proposed", s, v, p) for v, p in variants.items() for s in seeds])
    steps = runner.run_matrix(controlled_stream(spark), cells).where(F.col("kind") == "step")
    return steps.select("variant", "seed", (F.col("t") + 1).alias("t"), "rank", "accepted", "error", "threshold", "rank_changed", "updated")


def rank_summary(spark: SparkSession, seeds: tuple[int, ...] = SEEDS, variants: dict[str, dict] | None = None) -> DataFrame:
    """Rank telemetry and admission rate of each run on the controlled stream."""
    steps = controlled_trace(spark, seeds, variants or {"proposed": {}})
    told = traces.telemetry(steps, ["variant", "seed"])
    return told.join(steps.groupBy("variant", "seed").agg(F.avg(F.col("accepted").cast("double")).alias("admitted")), ["variant", "seed"])


def drift_response(spark: SparkSession, seeds: tuple[int, ...] = SEEDS, within: int = 500) -> DataFrame:
    """For each seed and drift of the controlled stream: delay of the first rank change, score before, recovery time, and false changes of the run."""
    cells = runner.run_cells(spark, [("proposed", s, "proposed", {}) for s in seeds])
    stream = controlled_stream(spark)
    changed = runner.run_matrix(stream, cells).where((F.col("kind") == "step") & F.col("rank_changed")).select("seed", (F.col("t") + 1).alias("t"), "rank")
    scores = runner.evaluate(stream, cells, 4, 1000, starts=10, steps=300)
    scores = scores.select("seed", (F.col("chunk") * 1000).alias("start"), ((F.col("chunk") + 1) * 1000).alias("end"), F.col("ari").alias("score"))
    every = cells.select("seed").withColumn("drift", F.explode(F.array(F.lit(3000).cast("long"), F.lit(6000).cast("long"))))
    false = traces.false_changes(changed, every, ["seed"], within).groupBy("seed").agg(F.count("*").alias("false_changes"))
    both = traces.adaptation_delay(changed, every, ["seed"], within).join(traces.recovery(scores, every, ["seed"]), ["seed", "drift"])
    return both.join(false, "seed", "left").withColumn("false_changes", F.coalesce("false_changes", F.lit(0)))


def state_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and state bytes of every method at the end of the stream."""
    done = runner.run_matrix(_stream(spark, sf_dir), _cells(spark, (7,)), CHUNK, ("final",))
    return done.select("method", "seed", "counters", F.get_json_object("counters", "$.state_bytes").cast("long").alias("state_bytes"))


def method_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m, *REGISTRY[m]) for m in METHODS], "method string, scope string, limits string")


def controlled_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated stream: rows and mean energy by phase and class."""
    s = read_controlled(spark, slices=3)
    energy = F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v)
    found = s.groupBy(F.floor(F.col("t") / 3000).cast("int").alias("phase"), "label").agg(F.count("*").alias("n"), F.avg(energy).alias("e"))
    return found.select("phase", F.col("label").cast("int").alias("label"), "n", F.round("e", 6).alias("energy"))


def _phases_sql() -> str:
    x, y, _ = generated()
    energy, phase = (x * x).sum(1), np.arange(len(y)) // 3000
    rows = [(p, c, at.sum(), round(float(energy[at].mean()), 6)) for p in range(3) for c in range(4) if (at := (phase == p) & (y == c)).any()]
    return "SELECT * FROM (VALUES " + ", ".join(f"({p}::INT, {c}::INT, {n}::BIGINT, {e!r}::DOUBLE)" for p, c, n, e in rows) + ") v(phase, label, n, energy)"


RADIUS, ROOM = 1.1, 50


def micro_cluster_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded micro-clusters without decay over the whole vector table: the final clusters."""
    return _kernel_run(spark, sf_dir, lambda x: MicroClusters(x.shape[1], RADIUS, ROOM), lambda m: (m.ids[: m.m], m.weight[: m.m], m.raw[: m.m].sum(1)))


def resonance_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resonance categories over the whole vector table, scaled to its first 1000 rows: the final categories."""

    def begin(x: np.ndarray) -> Resonance:
        return Resonance(x.shape[1])

    return _kernel_run(spark, sf_dir, begin, lambda r: (np.arange(r.n), r.count[: r.n], r.prototype[: r.n].sum(1)), scaled=True)


def _kernel_run(spark: SparkSession, sf_dir: str, begin, told, scaled: bool = False) -> DataFrame:
    """(id, weight, total) of a kernel's summary after the whole stream, which passes one ordered task in batches."""
    rows = tables.embeddings(spark, sf_dir).where(F.col("t").isNotNull()).select("t", "features")
    rows = rows.repartition(1).sortWithinPartitions("t")

    def work(batches):
        method, view, held = None, None, []
        for batch in batches:
            x = vectors.rows_of(batch)
            if method is None:
                held.append(x)
                if sum(map(len, held)) < runner.CALIBRATION:
                    continue
                x, held = np.concatenate(held), []
                method, view = begin(x), View(low=x[: runner.CALIBRATION].min(0), high=x[: runner.CALIBRATION].max(0)) if scaled else View()
            method.learn_all(view(x))
        if held:
            x = np.concatenate(held)
            method, view = begin(x), View(low=x.min(0), high=x.max(0)) if scaled else View()
            method.learn_all(view(x))
        if method is not None:
            i, w, total = told(method)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(i, np.int64)), pa.array(np.asarray(w, np.float64)), pa.array(np.round(total, 6))], ["id", "weight", "total"])

    return rows.mapInArrow(work, "id long, weight double, total double")


_ORDERED = """
WITH RECURSIVE e0 AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL),"""
# The state machines step by step: a row of the recursion is the whole state after n observations.
MICRO_SQL = _ORDERED + f"""
s(n, ids, cs, ws, ls, made) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::DOUBLE[][], []::DOUBLE[], []::BIGINT[], 0::BIGINT
  UNION ALL
  SELECT n, CASE WHEN hit THEN ids WHEN slot IS NULL THEN list_append(ids, made) ELSE list_transform(ids, lambda x, i: CASE WHEN i = slot THEN made ELSE x END) END,
         CASE WHEN hit THEN list_transform(cs, lambda c, i: CASE WHEN i = slot THEN list_transform(c, lambda y, k: (ws[slot] * y + v[k]) / (ws[slot] + 1)) ELSE c END)
              WHEN slot IS NULL THEN list_append(cs, v) ELSE list_transform(cs, lambda c, i: CASE WHEN i = slot THEN v ELSE c END) END,
         CASE WHEN hit THEN list_transform(ws, lambda w, i: CASE WHEN i = slot THEN w + 1 ELSE w END)
              WHEN slot IS NULL THEN list_append(ws, 1.0::DOUBLE) ELSE list_transform(ws, lambda w, i: CASE WHEN i = slot THEN 1.0::DOUBLE ELSE w END) END,
         CASE WHEN hit OR slot IS NOT NULL THEN list_transform(ls, lambda l, i: CASE WHEN i = slot THEN n ELSE l END) ELSE list_append(ls, n) END,
         CASE WHEN hit THEN made ELSE made + 1 END
  FROM (SELECT *, coalesce(d[near] <= {RADIUS}, false) AS hit,
               CASE WHEN coalesce(d[near] <= {RADIUS}, false) THEN near WHEN len(cs) < {ROOM} THEN NULL ELSE list_position(u, list_min(u)) END AS slot
        FROM (SELECT *, list_position(d, list_min(d)) AS near, list_transform(ws, lambda w, i: w / (1 + greatest(n - ls[i], 0))) AS u
              FROM (SELECT e0.n, e0.v, s.ids, s.cs, s.ws, s.ls, s.made,
                           list_transform(s.cs, lambda c: sqrt(list_sum(list_transform(c, lambda y, k: (y - e0.v[k]) * (y - e0.v[k]))))) AS d
                    FROM s JOIN e0 ON e0.n = s.n + 1)))),
z AS (SELECT * FROM s ORDER BY n DESC LIMIT 1)
SELECT unnest(ids) AS id, unnest(ws) AS weight, round(unnest(list_transform(cs, lambda c: list_sum(c))), 6) + 0.0 AS total FROM z"""
RESONANCE_SQL = _ORDERED + """
lim AS (SELECT list(lo ORDER BY k) AS lo, list(hi ORDER BY k) AS hi FROM
        (SELECT k, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e0 WHERE n <= 1000) GROUP BY k)),
x1 AS (SELECT n, list_transform(v, lambda x, k: greatest(0.0, least(1.0, (x - lo[k]) / (hi[k] - lo[k] + 1e-12)))) AS v FROM e0, lim),
x2 AS (SELECT n, list_concat(v, list_transform(v, lambda x: sqrt(x))) AS f FROM x1),
e1 AS (SELECT n, list_concat(f, list_transform(f, lambda x: 1 - x)) AS code FROM x2),
s(n, ps, ns) AS (
  SELECT 0::BIGINT, []::DOUBLE[][], []::DOUBLE[]
  UNION ALL
  SELECT n, CASE WHEN slot IS NULL THEN list_append(ps, code) ELSE list_transform(ps, lambda p, i: CASE WHEN i = slot THEN list_transform(p, lambda y, k: least(y, code[k])) ELSE p END) END,
         CASE WHEN slot IS NULL THEN list_append(ns, 1.0::DOUBLE) ELSE list_transform(ns, lambda w, i: CASE WHEN i = slot THEN w + 1 ELSE w END) END
  FROM (SELECT *, CASE WHEN list_max(t) IS NOT NULL THEN len(t) + 1 - list_position(list_reverse(t), list_max(t)) END AS slot
        FROM (SELECT *, list_transform(m, lambda y, i: CASE WHEN y / greatest(list_sum(code), 1e-12) >= 0.8 THEN y / (0.001 + list_sum(ps[i])) END) AS t
              FROM (SELECT e1.n, e1.code, s.ps, s.ns, list_transform(s.ps, lambda p: list_sum(list_transform(p, lambda y, k: least(y, e1.code[k])))) AS m
                    FROM s JOIN e1 ON e1.n = s.n + 1)))),
z AS (SELECT * FROM s ORDER BY n DESC LIMIT 1)
SELECT unnest(range(0, len(ps)))::BIGINT AS id, unnest(ns) AS weight, round(unnest(list_transform(ps, lambda p: list_sum(p))), 6) + 0.0 AS total FROM z"""


def write_in_order(rows: DataFrame, folder: str, n: int) -> None:
    """Rows (t, ...) as about n files in order of t, written one after another: a stream takes files by the time they were written."""
    cuts = rows.agg(F.percentile_approx("t", [k / n for k in range(1, n)], 10_000).alias("c")).first()["c"]
    edges = [None, *sorted(set(cuts or [])), None]
    for low, high in zip(edges, edges[1:]):
        part = rows if low is None else rows.where(F.col("t") > low)
        part = part if high is None else part.where(F.col("t") <= high)
        part.repartition(1).sortWithinPartitions("t").write.mode("append").parquet(folder)


def streamed_trace(spark: SparkSession, sf_dir: str, batch: int = BATCH) -> DataFrame:
    """The whole vector table as a file stream through the stateful operator, drained into a table of the checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="driftloom-stream-")
    base = f"{named}/stream-{uuid.uuid4().hex}"
    rows = tables.embeddings(spark, sf_dir).where(F.col("t").isNotNull()).select(F.lit("study").alias("run"), "t", "features")
    total = rows.select("t").distinct().count()
    write_in_order(rows, f"{base}/in", max(4, -(-total // batch)))
    config = {"study": {"original_dim": 64, "projection_dim": 64, "projection_mode": "identity", "window_size": 256, "seed": 7}}
    drain(learn_stream(stream_files(spark, f"{base}/in", "run string, t long, features array<double>"), config), f"{base}/out", f"{base}/state")
    trace = spark.read.parquet(f"{base}/out")
    if (learned := trace.count()) != total:
        raise RuntimeError(f"{learned} of {total} rows were learned: files came out of order")
    return trace


QUERIES = {
    "run_all_methods": all_methods,
    "run_final_partition": final_partition,
    "run_all_windows": all_windows,
    "run_proposed_trace": proposed_trace,
    "run_ablation": ablation,
    "run_sensitivity": sensitivity,
    "run_state_sizes": state_sizes,
    "method_registry": method_registry,
    "controlled_phases": controlled_phases,
    "streamed_trace": streamed_trace,
    "run_micro_clusters": micro_cluster_run,
    "run_resonance": resonance_run,
    "controlled_ranks": lambda spark, sf_dir: rank_summary(spark, SEEDS),
    "controlled_ablation": lambda spark, sf_dir: rank_summary(spark, (7, 13), ABLATION),
    "controlled_drift": lambda spark, sf_dir: drift_response(spark, (7, 13, 19)),
    "controlled_sensitivity": lambda spark, sf_dir: sensitivity_grid(spark),
}

ORACLE_SQL = {
    "method_registry": "SELECT * FROM (VALUES " + ", ".join("('" + "', '".join((m, *REGISTRY[m])) + "')" for m in METHODS) + ") v(method, scope, limits)",
    "controlled_phases": _phases_sql(),
    "run_micro_clusters": MICRO_SQL,
    "run_resonance": RESONANCE_SQL,
}
