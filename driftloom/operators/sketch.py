"""The adaptive sketch over a whole stream: draws, admissions, second moments of every window, bases and ranks.

Admission by a rate (``uniform``), of all rows with a weight of one (``off``), or by a leverage under given
bases (``sample``) needs no state that only one task could hold: the draw of row t is the t-th of the
generator's sequence, which any task reaches by a jump; a score's window is its bucket and a rim of the rows before it.

Second moments are sums.  Each block of admitted rows gives one Gram matrix (partial ones by Arrow batch, added
by block), the moments at a refresh are those of the blocks in its window, and one small eigenproblem for
each refresh is solved where its matrix lies.  Errors of the basis before are known for every rank at once,
so the only thing left in order is a recursion over a few numbers a refresh (``follow``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Admission, Rank
from ..session import checkpointed
from .ordered import BUCKET, running_sum, trailing
from .vectors import as_lists, rows_of


def draws(t: Column, seed: int) -> Column:
    """Entry t of ``numpy.random.default_rng(seed).random(...)``, for any t in any order."""

    @F.pandas_udf("double")
    def at(places: pd.Series) -> pd.Series:
        order = np.argsort(places.to_numpy(), kind="stable")
        sorted_places, out = places.to_numpy()[order], np.empty(len(places))
        starts = np.append(0, np.flatnonzero(np.diff(sorted_places) > 64) + 1)  # nearby ones are drawn together
        for a, b in zip(starts, np.append(starts[1:], len(out))):
            if b > a:
                first = int(sorted_places[a])
                run = np.random.Generator(np.random.PCG64(seed).advance(first)).random(int(sorted_places[b - 1]) - first + 1)
                out[order[a:b]] = run[sorted_places[a:b] - first]
        return pd.Series(out)

    return at(t.cast("long"))


def initial_leverage(features: Column, rank: int, ridge: float = 1e-3) -> Column:
    """Ridge leverage under the first basis: the first coordinates, each with a spectrum of one."""
    return F.aggregate(F.slice(features, 1, rank), F.lit(0.0), lambda a, x: a + x * x) / (1.0 + ridge)


def leverage_under(rows: DataFrame, bases: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """rows (t, features, epoch) with leverage under the basis of their epoch.

    bases: (epoch, rank, values, vectors), ``vectors`` one eigenvector after the other, of which the first ``rank`` count.
    Epochs without a basis, such as the one before the first refresh, give null.
    """
    kept = rows.columns
    schema = T.StructType([*rows.schema, T.StructField("leverage", T.DoubleType())])
    other = bases.select(F.col("epoch").alias("_epoch"), "rank", "values", "vectors")
    joined = rows.join(other, F.col("epoch") == F.col("_epoch"), "left").drop("_epoch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None] * b.num_rows
            has = np.flatnonzero(b.column("rank").is_valid().to_numpy(zero_copy_only=False))
            if len(has):
                part = b.take(pa.array(has))
                z, epoch = rows_of(part), part.column("epoch").to_numpy(zero_copy_only=False)
                for e in np.unique(epoch):
                    at = np.flatnonzero(epoch == e)
                    one = part.slice(int(at[0]), 1)
                    r = one.column("rank")[0].as_py()
                    h = z[at] @ rows_of(one, "vectors").reshape(-1, z.shape[1])[:r].T
                    lev = (h * h / (np.maximum(rows_of(one, "values")[0, :r], 0.0) + ridge)).sum(1)
                    for k, x in zip(has[at], lev):
                        out[k] = max(float(x), 0.0)
            yield pa.RecordBatch.from_arrays([*[b.column(name) for name in kept], pa.array(out, pa.float64())], schema.names)

    return joined.mapInArrow(run, schema)


def probabilities(scores: DataFrame, c: Admission, by: list[str] | None = None, size: int = BUCKET) -> DataFrame:
    """scores (by, t, leverage, others) with n, q and influence: the score among those of the rows up to ``window`` before.

    t counts from 0 without gaps within ``by``.
    """
    norms = trailing(scores, by or [], c.window, {"n": F.count("*"), "_sum": F.sum("leverage")}, size)
    total = F.col("_sum") + c.floor
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("leverage") + c.floor / F.col("n")) / total))
    out = norms.withColumn("q", F.when(total <= 1e-15, 1.0 / F.col("n")).otherwise(q))
    return out.withColumn("influence", F.col("n") * F.col("q")).drop("_sum")


def tilt(influence: Column, c: Admission) -> Column:
    """The saturating weight of an influence, once a threshold exists."""
    i = F.greatest(influence, F.lit(0.0))
    return F.least(F.lit(c.heaviest), F.greatest(F.lit(c.lightest), 0.5 + i / (1.0 + i)))


def admitted(rows: DataFrame, c: Admission, u: Column, by: list[str] | None = None, size: int = BUCKET) -> DataFrame:
    """rows (by, t, others; influence if the mode is sample) with prob, accepted, weight and ordinal (admitted rows so far).

    u: the row's uniform number, used by the modes sample and uniform.  Mode weight has weights of its own after the first refresh,
    which depend on the basis; here it is the state before.
    """
    if c.mode not in ("sample", "uniform", "weight", "off"):
        raise ValueError(f"unknown mode: {c.mode}")
    rate = c.rate * F.col("influence") if c.mode == "sample" else F.lit(c.rate)
    p = F.least(F.lit(c.most), F.greatest(F.lit(c.least), rate)) if c.mode in ("sample", "uniform") else F.lit(1.0)
    out = rows.withColumn("prob", p).withColumn("accepted", u <= F.col("prob") if c.mode in ("sample", "uniform") else F.lit(True))
    out = out.withColumn("weight", F.when(F.col("accepted"), 1.0 / F.greatest("prob", F.lit(1e-12))).otherwise(0.0))
    return running_sum(out, by or [], F.col("accepted").cast("long"), "ordinal", size)


def cells_of(k: int) -> np.ndarray:
    """(row, column) of each cell of a symmetric matrix's upper triangle."""
    return np.stack(np.triu_indices(k), 1)


def block_moments(rows: DataFrame, block: int) -> DataFrame:
    """block, cell, s: sums of weight z z' over blocks of ``block`` admitted rows; cell -1 is the weight.

    rows: (ordinal, weight, features) of admitted rows.  Each Arrow batch sends a row for each of its blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            z, w = rows_of(b), b.column("weight").to_numpy(zero_copy_only=False)
            at = (b.column("ordinal").to_numpy(zero_copy_only=False) - 1) // block
            order = np.argsort(at, kind="stable")
            numbers, first = np.unique(at[order], return_index=True)
            up, down = np.triu_indices(z.shape[1])
            sums = np.empty((len(numbers), len(up) + 1))
            for k, own in enumerate(np.split(order, first[1:])):
                sums[k, :-1] = ((z[own] * w[own, None]).T @ z[own])[up, down]
                sums[k, -1] = w[own].sum()
            yield pa.RecordBatch.from_arrays([pa.array(numbers), as_lists(sums)], ["block", "sums"])

    parts = rows.select("ordinal", "weight", "features").mapInArrow(run, "block long, sums array<double>")
    cells = parts.select("block", F.size("sums").alias("_n"), F.posexplode("sums").alias("cell", "s"))
    cells = cells.select("block", F.when(F.col("cell") == F.col("_n") - 1, -1).otherwise(F.col("cell")).alias("cell"), "s")
    return cells.groupBy("block", "cell").agg(F.sum("s").alias("s"))


def window_moments(rows: DataFrame, c: Admission, interval: int, size: int = 1 << 10) -> DataFrame:
    """refresh (from 1), cell, c: weighted second moments of the last ``window`` admitted rows at every ``interval``-th admission.

    Cells count the upper triangle row by row.  Blocks have the greatest length that divides both, so choose
    a window and an interval with a large common divisor: blocks then are few beside the rows.
    """
    block = math.gcd(c.window, interval)
    width = c.window // block
    sums = block_moments(rows, block).withColumnRenamed("block", "t")
    full = rows.agg(F.max("ordinal").alias("_last"))
    windows = trailing(sums, ["cell"], width - 1, {"_s": F.sum("s")}, max(size, width))
    ends = windows.where((F.col("t") + 1) * block % interval == 0).join(F.broadcast(full), (F.col("t") + 1) * block <= F.col("_last"))
    ends = ends.select(((F.col("t") + 1) * block / interval).cast("long").alias("refresh"), "cell", "_s")
    mass = ends.where("cell = -1").select(F.col("refresh").alias("_refresh"), F.greatest("_s", F.lit(1e-12)).alias("_mass"))
    return ends.where("cell >= 0").join(mass, F.col("refresh") == F.col("_refresh")).select("refresh", "cell", (F.col("_s") / F.col("_mass")).alias("c"))


def _square(upper: np.ndarray) -> np.ndarray:
    """Symmetric matrices from rows of upper triangles."""
    k = int((math.isqrt(8 * upper.shape[1] + 1) - 1) // 2)
    out = np.empty((len(upper), k, k))
    i, j = np.triu_indices(k)
    out[:, i, j] = upper
    out[:, j, i] = upper
    return out


def spectra(moments: DataFrame, c: Rank) -> DataFrame:
    """refresh, upper (the matrix), values (falling, none negative), vectors (one after the other), candidate (rank by energy)."""
    packed = moments.groupBy("refresh").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "c"))), lambda x: x["c"]).alias("upper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values, vectors = np.linalg.eigh(_square(rows_of(b, "upper")))
                values, vectors = np.maximum(values[:, ::-1], 0.0), vectors[:, :, ::-1].transpose(0, 2, 1)
                used = values[:, : c.most]
                total = used.sum(1)
                share = np.cumsum(used, 1) / np.where(total > 1e-15, total, 1.0)[:, None]
                rank = np.where(total > 1e-15, np.clip((share < c.energy).sum(1) + 1, c.least, c.most), c.least)
                columns = [b.column("refresh"), b.column("upper"), as_lists(values), as_lists(vectors.reshape(len(vectors), -1)), pa.array(rank.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["refresh", "upper", "values", "vectors", "candidate"])

    return packed.mapInArrow(run, "refresh long, upper array<double>, values array<double>, vectors array<double>, candidate int")


def errors(found: DataFrame, first: int = 1) -> DataFrame:
    """refresh, candidate, errors: what the basis of the refresh before misses of the moments, at every rank from 1 on.

    found: ``spectra``.  Before refresh ``first`` the basis is the coordinates.
    """
    before = found.select((F.col("refresh") + 1).alias("_refresh"), F.col("vectors").alias("_basis"))
    pairs = found.select("refresh", "candidate", "upper").join(before, F.col("refresh") == F.col("_refresh"), "left").where((F.col("refresh") == first) | F.col("_basis").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = _square(rows_of(b, "upper"))
            k = c.shape[1]
            bases = np.stack([np.eye(k) if x is None else np.reshape(x, (k, k)) for x in b.column("_basis").to_pylist()])
            kept = np.cumsum(np.einsum("nri,nij,nrj->nr", bases, c, bases), 1)
            energy = np.maximum(np.einsum("nii->n", c), 0.0)[:, None]
            missed = np.where(energy > 1e-24, np.sqrt(np.maximum(energy - kept, 0.0) / np.where(energy > 1e-24, energy, 1.0)), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("refresh"), b.column("candidate"), as_lists(missed)], ["refresh", "candidate", "errors"])

    return pairs.mapInArrow(run, "refresh long, candidate int, errors array<double>")


def follow(missed: DataFrame, c: Rank) -> DataFrame:
    """refresh, error, threshold, candidate, rank after each refresh of a run.

    A recursion by nature: the rank decides which error counts, and the errors decide the rank.  It passes one row of a few numbers for each
    refresh, in order, and holds three of them.
    """
    ordered = missed.repartitionByRange(1, "refresh").sortWithinPartitions("refresh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, threshold, calm = c.first, None, 0
        for b in batches:
            rows = []
            for refresh, candidate, by_rank in zip(*(b.column(x).to_pylist() for x in ("refresh", "candidate", "errors"))):
                error = by_rank[rank - 1]
                if threshold is None:
                    threshold = error
                else:
                    if error > threshold * (1.0 + c.tolerance):
                        rank, calm = max(rank, candidate), 0
                    else:
                        calm += 1
                        if calm >= c.patience:
                            rank, calm = min(rank, candidate), 0
                    threshold = c.smoothing * threshold + (1.0 - c.smoothing) * error
                rank = min(max(rank, c.least), c.most)
                rows.append((refresh, error, threshold, candidate, rank))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)][:3] + [pa.array([r[k] for r in rows], pa.int32()) for k in (3, 4)], ["refresh", "error", "threshold", "candidate", "rank"])

    return ordered.mapInArrow(run, "refresh long, error double, threshold double, candidate int, rank int")


def first_refresh(c: Rank, window: int) -> int:
    """The first refresh: enough admitted rows, at a multiple of the interval.  A window that never holds enough has none (0)."""
    need = max(c.most + 2, 64)
    return -(-need // c.interval) if window >= need else 0


def bases(rows: DataFrame, admission: Admission, rank: Rank) -> DataFrame:
    """epoch (number of the refresh), rank, values, vectors, error, threshold, candidate of a run over rows (ordinal, weight, features), the admitted ones."""
    first = first_refresh(rank, admission.window)
    found = checkpointed(spectra(window_moments(rows, admission, rank.interval).where((F.col("refresh") >= first) & F.lit(first > 0)), rank))
    told = follow(errors(found, first), rank).withColumnRenamed("refresh", "epoch").drop("candidate")
    return found.join(told, F.col("refresh") == F.col("epoch")).select("epoch", "rank", "values", "vectors", "error", "threshold", "candidate")


def epochs(rows: DataFrame, interval: int, first: int) -> Column:
    """The number of the basis in effect when a row arrives; 0 is the first one.  ordinal and accepted are of the row itself."""
    before = F.col("ordinal") - F.col("accepted").cast("long")
    e = F.floor(before / interval)
    return F.when(e >= first, e).otherwise(0).cast("long")
