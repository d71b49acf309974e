"""Consistency of published tables: summaries from records, macro means, counts, registries against folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The schema name that a run's record must carry.
RECORD_SCHEMA = "unified_primary_run_v1"
METRICS = ("online_chunk_mean_ari", "online_chunk_mean_nmi", "complete_window_final_ari", "complete_window_final_nmi", "coverage")


def record_checks(dataset: Column, method: Column, seed: Column, metrics: tuple[str, ...] = METRICS) -> dict[str, Column]:
    """The checks of a run's record, by the name of the error: schema, place in the matrix, whole stream, coverage, finite metrics."""
    finite = {f"metric:{m}": F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf")) for m in metrics}
    return {
        "schema": F.col("schema") == RECORD_SCHEMA,
        "dataset": F.col("dataset") == dataset,
        "method": F.col("method") == method,
        "seed": F.col("seed") == seed,
        "full_stream": F.col("full_stream"),
        "coverage": F.abs(F.col("coverage") - 1.0) <= 1e-12,
    } | finite


def summary_mismatches(records: DataFrame, summary: DataFrame, by: list[str], metrics: list[str], runs: int, tolerance: float = 1e-12) -> DataFrame:
    """by, what, found, told: groups whose number of records isn't `runs`, and means or sample spreads that records don't give.

    summary: by, <metric>_mean, <metric>_sd.  A group that only one side has is a mismatch of its count.
    """
    made = records.groupBy(*by).agg(F.count("*").cast("double").alias("n"), *[a for m in metrics for a in (F.avg(m).alias(f"_{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"_{m}_sd"))])
    told = summary.select(*[F.col(k).alias(f"_{k}") for k in by], *[F.col(f"{m}_{s}").cast("double").alias(f"{m}_{s}") for m in metrics for s in ("mean", "sd")], F.lit(float(runs)).alias("runs"))
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = made.join(told, same, "full")
    pairs = [F.struct(F.lit("count").alias("what"), F.coalesce("n", F.lit(0.0)).alias("found"), F.coalesce("runs", F.lit(0.0)).alias("told"))]
    pairs += [F.struct(F.lit(f"{m}_{s}").alias("what"), F.col(f"_{m}_{s}").alias("found"), F.col(f"{m}_{s}").alias("told")) for m in metrics for s in ("mean", "sd")]
    rows = both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in by], F.explode(F.array(*pairs)).alias("p")).select(*by, "p.what", "p.found", "p.told")
    return rows.where(F.coalesce(F.abs(F.col("found") - F.col("told")) > tolerance, F.lit(True)))


def macro_mismatches(means: DataFrame, by: list[str], parts: list[str], whole: str, tolerance: float = 5e-3) -> DataFrame:
    """by, found, told: rows whose `whole` isn't the plain mean of their parts."""
    found = sum((F.col(p).cast("double") for p in parts), F.lit(0.0)) / len(parts)
    return means.select(*by, found.alias("found"), F.col(whole).cast("double").alias("told")).where(F.coalesce(F.abs(F.col("found") - F.col("told")) > tolerance, F.lit(True)))


def set_difference(listed: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side: what only one of two sets has ('listed' or 'found'); no rows mean that they are equal."""
    a, b = listed.select(*keys).distinct(), found.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("listed")).union(b.exceptAll(a).withColumn("side", F.lit("found")))


def disagreements(runs: DataFrame, keys: list[str], column: str, one: str, other: str, metrics: list[str], tolerance: float = 1e-12) -> DataFrame:
    """keys and the largest difference, where two methods that must agree don't."""
    a, b = (runs.where(F.col(column) == v).select(*keys, *[F.col(m).alias(f"{m}_{i}") for m in metrics]) for i, v in enumerate((one, other)))
    gap = F.greatest(*[F.abs(F.col(f"{m}_0") - F.col(f"{m}_1")) for m in metrics], F.lit(0.0))
    return a.join(b, keys).select(*keys, gap.alias("gap")).where(F.col("gap") > tolerance)
