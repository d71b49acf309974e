"""SQL functions of the engine: `register(spark)` makes them known to a session for its time.

Scalar functions are SQL expressions that Catalyst inlines.  `ari` and `nmi` aggregate two columns of
labels; a group's labels come to one task in Arrow batches.  For groups of unbounded size, count pairs first:
`ari_of_counts(truth, pred, n)` and `nmi_of_counts` aggregate the counts, and so does the table function
`partition_quality(TABLE (SELECT part, truth, pred, count(*) ... GROUP BY ALL) PARTITION BY part)`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SCALARS = (
    "faded(weight DOUBLE, rate DOUBLE, age DOUBLE) RETURNS DOUBLE RETURN weight * pow(2D, -rate * age)",
    "admission_probability(influence DOUBLE, rate DOUBLE, least DOUBLE, most DOUBLE) RETURNS DOUBLE RETURN least(most, greatest(least, rate * influence))",
    "squared_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, d) -> s + d)",
    "nearest_center(x ARRAY<DOUBLE>, centers ARRAY<ARRAY<DOUBLE>>) RETURNS INT RETURN "
    "array_min(transform(centers, (c, i) -> struct(aggregate(zip_with(x, c, (p, q) -> (p - q) * (p - q)), 0D, (s, d) -> s + d) AS d, i AS i))).i",
)


def _pair_counts(a: pd.Series, b: pd.Series) -> np.ndarray:
    i, j = pd.factorize(a)[0], pd.factorize(b)[0]
    table = np.zeros((i.max(initial=-1) + 1, j.max(initial=-1) + 1))
    np.add.at(table, (i, j), 1)
    return table


def rand_index(table: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table; 1 where it has no variation."""
    n, pairs = table.sum(), lambda v: float((v * (v - 1) / 2).sum())
    if n < 2:
        return 1.0
    ij, i, j = pairs(table), pairs(table.sum(1)), pairs(table.sum(0))
    expected = i * j / (n * (n - 1) / 2)
    den = (i + j) / 2 - expected
    return 1.0 if abs(den) <= 1e-15 else (ij - expected) / den


def mutual_information(table: np.ndarray) -> float:
    """Mutual information over the mean of the entropies, within 0 and 1; 1 where both are 0."""
    if not table.sum():
        return 1.0
    p = table / table.sum()
    a, b, on = p.sum(1), p.sum(0), p > 0
    half = -(float((a * np.log(a)).sum()) + float((b * np.log(b)).sum())) / 2
    return 1.0 if half <= 1e-15 else min(1.0, max(0.0, float((p[on] * np.log(p[on] / np.outer(a, b)[on])).sum()) / half))


def _summed(truth: pd.Series, pred: pd.Series, n: pd.Series) -> np.ndarray:
    """The table of counts, from a row for each pair of labels that occurs; a pair may come in several."""
    a, b = pd.factorize(truth, use_na_sentinel=False)[0], pd.factorize(pred, use_na_sentinel=False)[0]
    table = np.zeros((a.max(initial=-1) + 1, b.max(initial=-1) + 1))
    np.add.at(table, (a, b), n.to_numpy(np.float64))
    return table


class PartitionQuality:
    """A row (part, ari, nmi) for each partition of rows (part, truth, pred, n)."""

    def __init__(self) -> None:
        self.part, self.rows = None, []

    def eval(self, row) -> None:
        self.part = row[0]
        self.rows.append((row[1], row[2], row[3]))

    def terminate(self):
        if self.rows:
            table = _summed(*(pd.Series(x) for x in zip(*self.rows)))
            yield None if self.part is None else str(self.part), float(rand_index(table)), float(mutual_information(table))


def register(spark: SparkSession) -> None:
    for text in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")

    @F.pandas_udf("double")
    def ari(truth: pd.Series, pred: pd.Series) -> float:
        return rand_index(_pair_counts(truth, pred))

    @F.pandas_udf("double")
    def nmi(truth: pd.Series, pred: pd.Series) -> float:
        return mutual_information(_pair_counts(truth, pred))

    @F.pandas_udf("double")
    def ari_of_counts(truth: pd.Series, pred: pd.Series, n: pd.Series) -> float:
        return rand_index(_summed(truth, pred, n))

    @F.pandas_udf("double")
    def nmi_of_counts(truth: pd.Series, pred: pd.Series, n: pd.Series) -> float:
        return mutual_information(_summed(truth, pred, n))

    spark.udtf.register("partition_quality", F.udtf(PartitionQuality, returnType="part string, ari double, nmi double"))
    spark.udf.register("ari_of_counts", ari_of_counts)
    spark.udf.register("nmi_of_counts", nmi_of_counts)
    spark.udf.register("ari", ari)
    spark.udf.register("nmi", nmi)
