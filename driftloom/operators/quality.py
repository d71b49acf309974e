"""Contingency tables, adjusted Rand index and normalized mutual information as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """by, truth, pred, n: pairs of labels with their counts."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def partition_quality(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """by, n, ari, nmi.  A single row, or partitions without variation, score 1 by convention; nmi is within 0 and 1."""
    cells = contingency(df, by, truth, pred)
    rows, cols = Window.partitionBy(*by, "truth"), Window.partitionBy(*by, "pred")
    every = Window.partitionBy(*(by or [F.lit(1)]))
    marked = (
        cells.withColumn("a", F.sum("n").over(rows))
        .withColumn("b", F.sum("n").over(cols))
        .withColumn("total", F.sum("n").over(every))
        .withColumn("first_a", F.row_number().over(rows.orderBy("pred")) == 1)
        .withColumn("first_b", F.row_number().over(cols.orderBy("truth")) == 1)
    )
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    part = lambda c: (F.col(c) / F.col("total")) * F.log(F.col(c) / F.col("total"))
    mutual = (F.col("n") / F.col("total")) * F.log(F.col("n") * F.col("total") / (F.col("a").cast("double") * F.col("b")))
    sums = marked.groupBy(*by).agg(
        F.max("total").alias("n"),
        F.sum(pairs("n")).alias("ij"),
        F.sum(F.when(F.col("first_a"), pairs("a"))).alias("ai"),
        F.sum(F.when(F.col("first_b"), pairs("b"))).alias("bj"),
        F.sum(mutual).alias("mi"),
        F.sum(F.when(F.col("first_a"), -part("a"))).alias("ha"),
        F.sum(F.when(F.col("first_b"), -part("b"))).alias("hb"),
    )
    expected = F.try_divide(F.col("ai") * F.col("bj"), F.col("n").cast("double") * (F.col("n") - 1) / 2)
    den = (F.col("ai") + F.col("bj")) / 2 - expected
    eps = F.lit(1e-15)
    ari = F.when((F.col("n") < 2) | (F.abs(den) <= eps), F.lit(1.0)).otherwise(F.try_divide(F.col("ij") - expected, den))
    half = (F.col("ha") + F.col("hb")) / 2
    nmi = F.when(half <= eps, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("mi"), half))))
    return sums.select(*by, F.col("n").cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"))


def windows_summary(quality: DataFrame, by: list[str]) -> DataFrame:
    """Observation-weighted and plain means over windows, with spread and range."""
    return quality.groupBy(*by).agg(
        F.count("*").alias("windows"),
        F.sum("n").alias("observations"),
        F.try_divide(F.sum(F.col("n") * F.col("ari")), F.sum("n")).alias("ari_weighted"),
        F.try_divide(F.sum(F.col("n") * F.col("nmi")), F.sum("n")).alias("nmi_weighted"),
        F.avg("ari").alias("ari_mean"),
        F.avg("nmi").alias("nmi_mean"),
        F.coalesce(F.stddev_samp("ari"), F.lit(0.0)).alias("ari_sd"),
        F.min("ari").alias("ari_min"),
        F.max("ari").alias("ari_max"),
        F.coalesce(F.stddev_samp("nmi"), F.lit(0.0)).alias("nmi_sd"),
        F.min("nmi").alias("nmi_min"),
        F.max("nmi").alias("nmi_max"),
    )
