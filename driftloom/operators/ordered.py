"""Prefix operators over long ordered groups in two levels: sums by bucket, prefixes of buckets, windows inside a bucket.

A plain window over a whole group is one task however long the group is.  Here rows meet by
(group, bucket) only; what crosses a bucket's edge travels in a table with a row for each bucket,
whose prefixes are taken in two levels themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16
SPAN = 1 << 10


def _on(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def before_buckets(sums: DataFrame, by: list[str], bucket: str, columns: list[str], span: int = SPAN) -> DataFrame:
    """sums (by, bucket, columns), a row for each bucket: adds <column>_before, the total over the group's smaller buckets (0 if none)."""
    marked = sums.withColumn("_span", F.floor(F.col(bucket) / span))
    spans = marked.groupBy(*by, "_span").agg(*[F.sum(c).alias(c) for c in columns])
    outer = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("_span").alias("__span"), *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"__{c}_far") for c in columns])
    inner = Window.partitionBy(*by, "_span").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    near = marked.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"__{c}_near") for c in columns])
    joined = near.join(spans, _on([*by, "_span"], [*[f"__{k}" for k in by], "__span"]))
    return joined.select(*sums.columns, *[(F.col(f"__{c}_near") + F.col(f"__{c}_far")).alias(f"{c}_before") for c in columns])


def ranked(df: DataFrame, by: list[str], coarse: Column, keys: list[str], name: str = "t") -> DataFrame:
    """Adds the rank from 0 by `keys` within by; coarse is a whole number that never decreases along the keys."""
    marked = df.withColumn("_bucket", coarse)
    sizes = before_buckets(marked.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")), by, "_bucket", ["_n"])
    offsets = sizes.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("_bucket").alias("__bucket"), F.col("_n_before").alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*keys)) - 1
    out = marked.withColumn("_inside", inside).join(offsets, _on([*by, "_bucket"], [*[f"__{k}" for k in by], "__bucket"]))
    return out.withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long")).select(*df.columns, name)


def running_sum(df: DataFrame, by: list[str], value: Column, name: str, size: int = BUCKET) -> DataFrame:
    """Adds the sum of a whole number over the rows up to this one, by t within by.  t: distinct within by."""
    marked = df.withColumn("_bucket", F.floor(F.col("t") / size)).withColumn("_v", value.cast("long"))
    sums = before_buckets(marked.groupBy(*by, "_bucket").agg(F.sum("_v").alias("_n")), by, "_bucket", ["_n"])
    offsets = sums.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("_bucket").alias("__bucket"), F.col("_n_before").alias("_offset"))
    inside = F.sum("_v").over(Window.partitionBy(*by, "_bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("_inside", inside).join(offsets, _on([*by, "_bucket"], [*[f"__{k}" for k in by], "__bucket"]))
    return out.withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long")).select(*df.columns, name)


def trailing(df: DataFrame, by: list[str], width: int, aggregates: dict[str, Column], size: int = BUCKET) -> DataFrame:
    """Adds aggregates over each row and up to ``width`` rows before it.  t: without gaps within by.

    Each bucket of t takes a rim of the ``width`` rows before it along, so no task sees more than both, and one shuffle does.
    """
    size = max(size, width, 1)
    bucket = F.floor(F.col("t") / size)
    rim = F.when(F.col("t") >= (bucket + 1) * size - width, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    rows = df.withColumn("_own", bucket).withColumn("_bucket", F.explode(rim))
    w = Window.partitionBy(*by, "_bucket").orderBy("t").rowsBetween(-width, 0)
    told = rows.select("*", *[a.over(w).alias(k) for k, a in aggregates.items()])
    return told.where(F.col("_own") == F.col("_bucket")).select(*df.columns, *aggregates)


def previous(df: DataFrame, by: list[str], column: str, name: str, size: int = BUCKET) -> DataFrame:
    """Adds the column's value in the row before (by t within by); null in the first row.  t: distinct within by."""
    marked = df.withColumn("_bucket", F.floor(F.col("t") / size))
    lasts = marked.groupBy(*by, "_bucket").agg(F.max_by(F.struct(column), "t").alias("_last"))
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket")
    edges = lasts.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("_bucket").alias("__bucket"), F.lag("_last").over(across).alias("_edge"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("t")
    out = marked.withColumn("_near", F.lag(F.struct(column)).over(inside)).join(edges, _on([*by, "_bucket"], [*[f"__{k}" for k in by], "__bucket"]))
    return out.withColumn(name, F.coalesce("_near", "_edge")[column]).select(*df.columns, name)


def moments_before(cells: DataFrame, size: int = BUCKET) -> DataFrame:
    """cells (t, dim, v): adds n, mean and m2 (sum of squared deviations) of the dim's earlier rows."""
    marked = cells.withColumn("_bucket", F.floor(F.col("t") / size))
    sums = marked.groupBy("dim", "_bucket").agg(F.count("v").alias("_n"), F.avg("v").alias("_mean"), (F.var_pop("v") * F.count("v")).alias("_m2"))
    # Means are held against that of the dim's first bucket, so that squares don't cancel.
    base = F.first("_mean", ignorenulls=True).over(Window.partitionBy("dim").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sums = sums.withColumn("_base", base).withColumn("_off", F.coalesce(F.col("_mean") - F.col("_base"), F.lit(0.0)))
    sums = sums.select("dim", "_bucket", "_base", "_n", (F.col("_n") * F.col("_off")).alias("_s"), (F.coalesce("_m2", F.lit(0.0)) + F.col("_n") * F.col("_off") * F.col("_off")).alias("_q"))
    far = before_buckets(sums, ["dim"], "_bucket", ["_n", "_s", "_q"])
    n0 = F.col("_n_before")
    far = far.select(
        F.col("dim").alias("__dim"),
        F.col("_bucket").alias("__bucket"),
        n0.alias("_n0"),
        F.when(n0 > 0, F.col("_base") + F.col("_s_before") / n0).alias("_mean0"),
        F.when(n0 > 0, F.greatest(F.col("_q_before") - F.col("_s_before") * F.col("_s_before") / n0, F.lit(0.0))).otherwise(0.0).alias("_m20"),
    )
    w = Window.partitionBy("dim", "_bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    near = marked.select("*", F.count("v").over(w).alias("_n1"), F.avg("v").over(w).alias("_mean1"), F.var_pop("v").over(w).alias("_var1"))
    out = near.join(far, _on(["dim", "_bucket"], ["__dim", "__bucket"]))
    n = F.col("_n0") + F.col("_n1")
    apart = F.col("_mean1") - F.col("_mean0")
    mean = F.coalesce(F.col("_mean0") + apart * F.col("_n1") / n, "_mean1", "_mean0")
    m2 = F.col("_m20") + F.coalesce(F.col("_var1") * F.col("_n1"), F.lit(0.0)) + F.coalesce(apart * apart * F.col("_n0") * F.col("_n1") / n, F.lit(0.0))
    return out.select(*cells.columns, n.alias("n"), mean.alias("mean"), m2.alias("m2"))
