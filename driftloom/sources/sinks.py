"""Writers of run results: only below a results folder, never over protected ones, resumable."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROTECTED = "results/main_results"
WRITABLE = "results/execution_runs"


def guarded(path: str, protected: str = PROTECTED, writable: str = WRITABLE) -> str:
    """The path, if it lies below the writable folder; ValueError otherwise."""
    clean = posixpath.normpath(path) if "://" not in path else path
    if f"/{protected}" in f"/{clean}" or f"/{writable}" not in f"/{clean}":
        raise ValueError(f"{path} is not below {writable}")
    return path


def write_runs(runs: DataFrame, path: str, force: bool = False) -> None:
    """JSON records by data set, method and seed."""
    runs.write.mode("overwrite" if force else "errorifexists").partitionBy("dataset", "method", "seed").json(guarded(path))


def resume_runs(runs: DataFrame, path: str, force: bool = False) -> None:
    """Adds JSON records to those that are there, each in the folder of its data set, method and seed.

    A record takes the place of an earlier one of its run, and appears when the whole job is done: files are staged first and folders
    moved at the end.  So a job that died, even while it moved them, can be run again, and two at once leave one record for each run.
    With force, all earlier records go.
    """
    keys = ("dataset", "method", "seed")
    how = "static" if force else "dynamic"
    runs.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy(*keys).json(guarded(path))


def write_table(df: DataFrame, path: str, kind: str = "parquet", force: bool = False) -> None:
    """Parquet, or CSV with a header."""
    writer = df.write.mode("overwrite" if force else "errorifexists")
    writer.csv(guarded(path), header=True) if kind == "csv" else writer.parquet(guarded(path))


def manifest(runs: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: expected, present and missing runs, and whether all are there."""
    marked = expected.join(runs.select(*keys).distinct().withColumn("_here", F.lit(True)), keys, "left")
    counts = marked.agg(F.count("*").alias("expected"), F.count("_here").alias("present"))
    return counts.withColumn("missing", F.col("expected") - F.col("present")).withColumn("complete", F.col("missing") == 0)


def still_to_run(planned: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Planned runs without a result; all of them with force."""
    return planned if force else planned.join(done.select(*keys).distinct(), keys, "left_anti")
