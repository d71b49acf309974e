"""Vector operators: causal and range standardization, projection, nearest centers, neighbors, Lloyd steps.

The relational forms work on (t, dim, value) rows, so any width distributes; windows are by dim and
bucket of arrival numbers, so none spans a whole stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import BUCKET, moments_before

SMALL_ROWS = 200_000  # rows of a table that is broadcast or collected, at most


def melt(stream: DataFrame, features: str = "features") -> DataFrame:
    """t, dim (from 0), v."""
    return stream.select("t", F.posexplode(features).alias("dim", "v")).select("t", "dim", F.col("v").cast("double").alias("v"))


def finite(v: Column) -> Column:
    """NaN as 0, infinities as the largest doubles."""
    top = float(np.finfo(np.float64).max)
    return F.when(F.isnan(v), 0.0).when(v == float("inf"), top).when(v == float("-inf"), -top).otherwise(v)


def causal_standardize(cells: DataFrame, eps: float = 1e-8, size: int = BUCKET) -> DataFrame:
    """t, dim, z: each value by mean and spread of the rows before it; the first two rows are only centered.

    Rows meet by dim and bucket of `size` arrival numbers, so tasks grow with the stream, not only with its width.
    """
    seen = moments_before(cells, size)
    off = F.col("v") - F.coalesce("mean", F.lit(0.0))
    z = F.when(F.col("n") < 2, off).otherwise(F.try_divide(off, F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1) + eps)))
    return seen.select("t", "dim", finite(z).alias("z"))


def range_scale(cells: DataFrame, prefix: int | None = None, eps: float = 1e-12) -> DataFrame:
    """t, dim, z in 0..1 by the range of each dim over rows with t < prefix (all rows if None)."""
    seen = cells if prefix is None else cells.where(F.col("t") < prefix)
    bounds = seen.groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.col("hi") - F.col("lo") + eps if prefix is not None else F.greatest(F.col("hi") - F.col("lo"), F.lit(eps))
    scaled = (F.col("v") - F.col("lo")) / width
    if prefix is not None:
        scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))
    return cells.join(bounds, "dim").select("t", "dim", scaled.alias("z"))


def sparse_range_scale(cells: DataFrame, eps: float = 1e-12) -> DataFrame:
    """t, dim, z of sparse cells: values over the largest of their dim.  Absent cells stay 0, so a negative value raises: it would make them dense."""
    low = F.raise_error(F.concat(F.lit("negative value in dim "), F.col("dim").cast("string"))).cast("double")
    checked = cells.withColumn("v", F.when(F.col("v") < -eps, low).otherwise(F.col("v")))
    top = checked.groupBy(F.col("dim").alias("_dim")).agg(F.max("v").alias("hi"))
    return checked.join(top, F.col("dim") == F.col("_dim")).select("t", "dim", (F.col("v") / F.greatest("hi", F.lit(eps))).alias("z"))


def project(cells: DataFrame, omega: DataFrame) -> DataFrame:
    """t, j, z: rows times a (dim, j, w) matrix, whose size the configuration bounds."""
    return cells.join(small(omega), "dim").groupBy("t", "j").agg(F.sum(F.col("v") * F.col("w")).alias("z"))


def project_batches(stream: DataFrame, omega: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """t, features times omega, and the columns of keep, by Arrow batches; the fast form of `project` for dense rows."""
    shared = stream.sparkSession.sparkContext.broadcast(omega)
    schema = T.StructType([stream.schema["t"], T.StructField("features", T.ArrayType(T.DoubleType())), *[stream.schema[c] for c in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = rows_of(b) @ shared.value
                yield pa.RecordBatch.from_arrays([b.column("t"), as_lists(z), *[b.column(c) for c in keep]], schema.names)

    return stream.select("t", "features", *keep).mapInArrow(run, schema)


def rows_of(batch: pa.RecordBatch, column: str = "features") -> np.ndarray:
    """A column of lists as a matrix; rows of unequal or missing width raise."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if lists.null_count or len(flat) % max(len(lists), 1) or len(set(lists.value_lengths().to_pylist())) > 1:
        raise ValueError("rows of a stream have one width")
    return flat.reshape(len(lists), -1)


def as_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if it has that many rows at most; else as it is, and joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def center_matrix(centers: DataFrame, rows: int = SMALL_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """(numbers, rows) of a table (center, dim, c) by rising number; None if it has more cells than that."""
    found = centers.select(F.col("center").cast("long"), F.col("dim").cast("long"), F.col("c").cast("double")).limit(rows + 1).collect()
    if len(found) > rows:
        return None
    numbers = sorted({r[0] for r in found})
    place = {n: i for i, n in enumerate(numbers)}
    m = np.zeros((len(numbers), max((r[1] for r in found), default=-1) + 1))
    for n, dim, c in found:
        m[place[n], dim] = c
    return np.array(numbers, np.int64), m


def squared_to(x: np.ndarray, c: np.ndarray, digits: int = 9) -> np.ndarray:
    """Squared distances of rows to centers by differences, rounded."""
    out = np.empty((len(x), len(c)))
    for j, row in enumerate(c):
        off = x - row
        out[:, j] = np.einsum("ij,ij->i", off, off)
    return np.round(out, digits)


def nearest_rows(stream: DataFrame, centers: DataFrame, keep: tuple[str, ...] = (), rows: int = SMALL_ROWS) -> DataFrame:
    """t, center, d2 and the columns of keep: `nearest` of dense rows (t, features) by Arrow batches.

    The centers are collected behind a check of their number; more of them go the way of joins.
    """
    held = center_matrix(centers, rows)
    if held is None:
        near = nearest(melt(stream), centers)
        return near if not keep else near.join(stream.select("t", *keep), "t")
    numbers, matrix = held
    schema = T.StructType([stream.schema["t"], T.StructField("center", T.LongType()), T.StructField("d2", T.DoubleType()), *[stream.schema[c] for c in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(numbers):
                d2 = squared_to(rows_of(b), matrix)
                j = d2.argmin(1)  # the first, which is the smaller center, in ties
                yield pa.RecordBatch.from_arrays([b.column("t"), pa.array(numbers[j]), pa.array(d2[np.arange(len(j)), j]), *[b.column(c) for c in keep]], schema.names)

    found = stream.select("t", "features", *keep).mapInArrow(run, schema)
    return found.withColumn("center", F.col("center").cast(centers.schema["center"].dataType))


def lloyd_rows(stream: DataFrame, centers: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Centers after one weighted step over dense rows (t, features, w); each batch sends a sum and a mass for each center."""
    held = center_matrix(centers, rows)
    if held is None:
        return lloyd_step(melt(stream), stream.select("t", "w"), centers)
    numbers, matrix = held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(numbers):
                x, w = rows_of(b), b.column("w").to_numpy(zero_copy_only=False).astype(np.float64)
                owner = np.equal.outer(np.arange(len(numbers)), squared_to(x, matrix).argmin(1)) * w
                on = owner.sum(1) > 0
                yield pa.RecordBatch.from_arrays([pa.array(numbers[on]), as_lists((owner @ x)[on]), pa.array(owner.sum(1)[on])], ["own", "sums", "mass"])

    parts = stream.select("features", "w").mapInArrow(run, "own long, sums array<double>, mass double")
    parts = parts.select("own", "mass", F.posexplode("sums").alias("dim2", "s"))
    moved = parts.groupBy("own", "dim2").agg((F.sum("s") / F.sum("mass")).alias("m"))
    joined = centers.join(moved, (centers["center"] == moved["own"]) & (centers["dim"] == moved["dim2"]), "left")
    return joined.select(centers["center"], centers["dim"], F.coalesce("m", "c").alias("c"))


def class_centers(stream: DataFrame, label: str = "label") -> DataFrame:
    """center, dim, c: mean of each dim over each class."""
    cells = stream.select("t", label, F.posexplode("features").alias("dim", "v"))
    return cells.groupBy(F.col(label).alias("center"), "dim").agg(F.avg(F.col("v").cast("double")).alias("c"))


def weighted_centers(cells: DataFrame, by: str, weight: str) -> DataFrame:
    """by, dim, c: weighted mean."""
    return cells.groupBy(by, "dim").agg((F.sum(F.col("v") * F.col(weight)) / F.sum(weight)).alias("c"))


def distances(cells: DataFrame, centers: DataFrame) -> DataFrame:
    """t, center, d2 for every row and center; centers are broadcast if they are few."""
    return cells.join(small(centers), "dim").groupBy("t", "center").agg(F.sum((F.col("v") - F.col("c")) * (F.col("v") - F.col("c"))).alias("d2"))


def nearest(cells: DataFrame, centers: DataFrame, digits: int = 9) -> DataFrame:
    """t, center, d2: the nearest center of each row, the smaller one where distances agree to `digits`."""
    d = distances(cells, centers).withColumn("d2", F.round("d2", digits))
    best = d.groupBy("t").agg(F.min(F.struct("d2", "center")).alias("b"))
    return best.select("t", F.col("b.center").alias("center"), F.col("b.d2").alias("d2"))


def neighbors(points: DataFrame, k: int, itself: bool, digits: int = 9) -> DataFrame:
    """i, j, d, place: the k nearest rows of each row of a bounded prefix, ties to the smaller row."""
    other = points.select(F.col("t").alias("j"), "dim", F.col("v").alias("u"))
    pairs = points.withColumnRenamed("t", "i").join(small(other), "dim").groupBy("i", "j").agg(F.sum((F.col("v") - F.col("u")) * (F.col("v") - F.col("u"))).alias("d2"))
    pairs = pairs if itself else pairs.where(F.col("i") != F.col("j"))
    w = Window.partitionBy("i").orderBy("d", "j")
    return pairs.select("i", "j", F.round(F.sqrt("d2"), digits).alias("d")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def nearest_in_block(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray, k: int, itself: bool, step: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d) of the k rows of x nearest to each row of q by (d to nine digits, j).

    Products find the rows that may be among the k, with slack for their error; differences give the distances.
    """
    step = step or min(256, max(8, (1 << 21) // max(len(x), 1)))  # 16 MB of distances
    qq, xx, found = (q * q).sum(1), (x * x).sum(1), []
    top = float(xx.max(initial=0.0))
    for a in range(0, len(q), step):
        b = min(a + step, len(q))
        d2 = np.maximum(qq[a:b, None] + xx[None, :] - 2.0 * (q[a:b] @ x.T), 0.0)
        own = qi[a:b, None] == xi[None, :]
        if not itself:
            d2[own] = np.inf
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1] if k <= len(x) else np.full(b - a, np.inf)
        may = d2 <= (kth + 4e-9 * np.sqrt(kth) + 1e-12 * (qq[a:b] + top) + 1e-15)[:, None]
        if not itself:
            may &= ~own
        row, col = np.nonzero(may)
        d = np.empty(len(row))
        for s in range(0, len(row), 1 << 16):
            e = slice(s, s + (1 << 16))
            off = q[a + row[e]] - x[col[e]]
            d[e] = np.sqrt(np.einsum("ij,ij->i", off, off))
        order = np.lexsort((xi[col], np.round(d, 9), row))
        row, col, d = row[order], col[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        found.append((qi[a + row[keep]], xi[col[keep]], d[keep]))
    return tuple(np.concatenate(p) for p in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def calibration_radius(points: DataFrame, k: int = 6, share: float = 0.8) -> DataFrame:
    """radius: a quantile of the distances to the k-th nearest row, itself included."""
    return radius_of(neighbors(points, k, itself=True), k, share)


def radius_of(near: DataFrame, k: int = 6, share: float = 0.8) -> DataFrame:
    far = near.where(F.col("place") == k)
    return far.agg(F.greatest(F.expr(f"percentile(d, {share})"), F.lit(1e-6)).alias("radius"))


def closest_pair(centers: DataFrame, digits: int = 9) -> DataFrame:
    """a, b, d2: the two closest centers."""
    other = centers.select(F.col("center").alias("b"), "dim", F.col("c").alias("u"))
    pairs = centers.withColumnRenamed("center", "a").join(small(other), "dim").where(F.col("a") < F.col("b"))
    d = pairs.groupBy("a", "b").agg(F.round(F.sum((F.col("c") - F.col("u")) * (F.col("c") - F.col("u"))), digits).alias("d2"))
    return d.agg(F.min(F.struct("d2", "a", "b")).alias("m")).select("m.a", "m.b", "m.d2")


def lloyd_step(cells: DataFrame, weights: DataFrame, centers: DataFrame) -> DataFrame:
    """Centers after one weighted step; a center without rows stays.  weights: (t, w)."""
    owner = nearest(cells, centers).select("t", F.col("center").alias("own"))
    moved = cells.join(owner, "t").join(weights, "t").groupBy("own", "dim").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    joined = centers.join(moved, (centers["center"] == moved["own"]) & (centers["dim"] == moved["dim"]), "left")
    return joined.select(centers["center"], centers["dim"], F.coalesce("m", "c").alias("c"))


def mass_to_representatives(cells: DataFrame, weights: DataFrame, reps: DataFrame) -> DataFrame:
    """center, mass: all weight goes to the nearest representative, so the total stays."""
    return nearest(cells, reps).join(weights, "t").groupBy("center").agg(F.sum("w").alias("mass"))


def first_within(cells: DataFrame, centers: DataFrame, radius: float) -> DataFrame:
    """t, center: the nearest center within a radius; null if none is."""
    d = nearest(cells, centers)
    return d.select("t", F.when(F.sqrt("d2") <= radius, F.col("center")).alias("center"))


def first_fitting(cells: DataFrame, clusters: DataFrame, radius: float, digits: int = 9) -> DataFrame:
    """t, center: of the clusters whose spread stays within the radius with the row added, the one with the nearest mean; null if none.

    clusters: (center, dim, ls, ss, w), linear and squared sums with a weight.  The nearest cluster may not fit where a farther one does.
    """
    mean, w = F.col("ls") / F.greatest("w", F.lit(1e-12)), F.col("w") + 1.0
    grown = (F.col("ls") + F.col("v")) / w
    spread = F.greatest((F.col("ss") + F.col("v") * F.col("v")) / w - grown * grown, F.lit(0.0))
    both = cells.join(small(clusters), "dim").groupBy("t", "center")
    told = both.agg(F.round(F.sum((F.col("v") - mean) * (F.col("v") - mean)), digits).alias("d2"), F.round(F.sqrt(F.sum(spread)), digits).alias("r"))
    best = told.groupBy("t").agg(F.min(F.when(F.col("r") <= radius, F.struct("d2", "center"))).alias("b"))
    return best.select("t", F.col("b.center").alias("center"))


def resonance_code(features: Column, power: float = 0.5) -> Column:
    """Complement code of clipped values and their powers, 4 times as wide."""
    x = F.transform(features, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v.cast("double"))))
    s = F.concat(x, F.transform(x, lambda v: F.pow(v, F.lit(power))))
    return F.concat(s, F.transform(s, lambda v: 1.0 - v))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def resonance_choice(coded: DataFrame, prototypes: DataFrame, vigilance: float = 0.8, choice: float = 0.001, digits: int = 9) -> DataFrame:
    """t, category: of the prototypes that match well enough the one with the largest choice value, the later in ties; null if none."""
    if prototypes.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} prototypes: code them in blocks")
    both = coded.crossJoin(F.broadcast(prototypes))  # every row against a summary of checked size
    match = total(F.zip_with("code", "proto", lambda a, b: F.least(a, b)))
    both = both.withColumn("match", match).withColumn("value", F.round(F.col("match") / (choice + total(F.col("proto"))), digits))
    fits = F.round(F.try_divide(F.col("match"), F.greatest(total(F.col("code")), F.lit(1e-12))), digits) >= vigilance
    best = both.groupBy("t").agg(F.max(F.when(fits, F.struct("value", "category"))).alias("b"))
    return best.select("t", F.col("b.category").alias("category"))
