"""The study's data sets: prepared files first, packaged ones where allowed, with what is known of their origin."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DATASETS
from . import files
from .controlled import read_controlled

PACKED_WIDTH = 256  # of the packaged text representation, which isn't derived from the canonical one


@dataclass(frozen=True)
class Loaded:
    """A stream (t, features, label), or (t, dim, v) with labels apart for a sparse one, and its origin."""

    stream: DataFrame
    labels: DataFrame
    dataset: str
    source: str
    canonical: bool
    sparse: bool = False


def paired_by_position(rows: DataFrame, labels: DataFrame, column: str = "label") -> DataFrame:
    """rows (t, ...) with the label (t, label) of each; a row without a label raises, and so does a label without a row."""
    known = labels.select(F.col("t").alias("_t"), F.col(column).alias("_label"), F.lit(True).alias("_there"))
    joined = rows.withColumn("_here", F.lit(True)).join(known, F.col("t") == F.col("_t"), "full")
    whole = F.col("_here") & F.col("_there")
    stop = F.raise_error(F.concat(F.lit("rows and labels differ at t = "), F.coalesce("t", "_t").cast("string"))).cast("boolean")
    return joined.where(F.coalesce(whole, stop)).withColumn(column, F.col("_label")).select(*[c for c in rows.columns if c != column], column)


def read_csr(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """(t, dim, v) of a compressed-row archive (data, indices, indptr, shape); rows are never made dense."""
    with np.load(io.BytesIO(files.verified_bytes(spark, path, sha256)), allow_pickle=False) as a:
        data, indices, starts, shape = (a[k] for k in ("data", "indices", "indptr", "shape"))
    if len(starts) != shape[0] + 1 or len(data) != len(indices) or (len(indices) and indices.max() >= shape[1]):
        raise ValueError(f"{path} is no consistent row archive")
    rows = [(i, indices[a:b].tolist(), data[a:b].astype(np.float64).tolist()) for i, (a, b) in enumerate(zip(starts, starts[1:]))]
    packed = spark.createDataFrame(rows, "t long, indices array<int>, values array<double>")
    return packed.select("t", F.explode(F.arrays_zip("indices", "values")).alias("c")).select("t", F.col("c.indices").alias("dim"), F.col("c.values").alias("v"))


def load(spark: SparkSession, root: str, dataset: str, packaged: bool = False) -> Loaded:
    """The data set from <root>/prepared, else from <root>/packaged.  The packaged text
    representation has another width and another origin: it is read only if `packaged` asks for it.
    The generated stream needs no file.  Shapes are checked; FileNotFoundError where nothing is there."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown data set: {dataset}")
    d = DATASETS[dataset]
    if dataset == "tweeteval":
        try:
            cells = read_csr(spark, f"{root}/prepared/tweeteval_x.npz")
            labels = files.read_npz_labels(spark, f"{root}/prepared/tweeteval_y.npz", d["rows"])
            return Loaded(cells, labels, dataset, f"{root}/prepared", True, True)
        except Exception as e:
            if not files.is_absent(e) or not packaged:
                raise FileNotFoundError("the canonical text features aren't there, and the packaged ones weren't asked for") if files.is_absent(e) else e
    width = PACKED_WIDTH if dataset == "tweeteval" else d["width"]
    for folder in ("packaged",) if dataset == "tweeteval" else ("prepared", "packaged"):
        try:
            stream = files.check_shape(files.read_npz(spark, f"{root}/{folder}/{dataset}.npz", d["rows"]), d["rows"], width)
            return Loaded(stream, stream.select("t", "label"), dataset, f"{root}/{folder}", dataset != "tweeteval")
        except Exception as e:
            if not files.is_absent(e):
                raise
    if dataset == "synthetic_gmm":
        stream = read_controlled(spark)
        return Loaded(stream, stream.select("t", "label"), dataset, "generated", True)
    raise FileNotFoundError(f"{dataset} is neither in {root}/prepared nor in {root}/packaged")
