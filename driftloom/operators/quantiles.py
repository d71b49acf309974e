"""Exact quantiles of many groups at once, without a buffer of a group's values.

A double is a whole number in the same order, by its bits.  The value at a rank is found by its 16 leading bits, then the next
16, and so on: each of four rounds counts, in partial sums, the values of a group by 16 bits among those that share the bits
found so far.  So what meets in one place is at most 65536 counts, however many values a group has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed

ROUNDS = (48, 32, 16, 0)


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """The bits of a double as a whole number that rises with it; both zeros are one, NaN is the largest."""
    v = x.to_numpy(np.float64) + 0.0
    bits = np.where(np.isnan(v), np.float64("nan"), v).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(T.DoubleType())
def from_bits(x: pd.Series) -> pd.Series:
    bits = x.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


def _same(by: list[str], other: str) -> Column:
    same = F.lit(True)
    for x in by:
        same = same & F.col(x).eqNullSafe(F.col(f"{other}{x}"))
    return same


def exact_quantiles(df: DataFrame, by: list[str], value: Column, shares: list[float]) -> DataFrame:
    """by, share, quantile: linear between the two values around a share's place.  Null values are left out; a group without values has no row."""
    rows = checkpointed(df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull()).select(*by, ordered_bits("_v").alias("_bits")))
    wanted = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > 0).withColumn("share", F.explode(F.lit([float(s) for s in shares])))
    place = (F.col("_n") - 1) * F.col("share")
    ends = F.array(F.struct(F.lit(0).alias("end"), F.floor(place).alias("rank")), F.struct(F.lit(1).alias("end"), F.ceil(place).alias("rank")))
    targets = wanted.withColumn("_part", place - F.floor(place)).withColumn("_e", F.explode(ends)).select(*by, "share", "_part", F.col("_e.end").alias("_end"), F.col("_e.rank").cast("long").alias("_rank"), F.lit(None).cast("long").alias("_prefix"))
    for k, shift in enumerate(ROUNDS):
        found = F.shiftright("_bits", shift)
        part = rows
        if k:
            open_ = targets.select(*[F.col(x).alias(f"_o{x}") for x in by], F.col("_prefix").alias("_p")).distinct()
            part = rows.join(open_, _same(by, "_o") & (F.shiftright("_bits", ROUNDS[k - 1]) == F.col("_p")), "left_semi")
        counts = part.groupBy(*[F.col(x).alias(f"_c{x}") for x in by], found.alias("_found")).agg(F.count("*").alias("_m"))
        counts = counts.withColumn("_above", F.shiftright("_found", 16) if k else F.lit(0))
        w = Window.partitionBy(*[f"_c{x}" for x in by], "_above").orderBy("_found").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_less", F.coalesce(F.sum("_m").over(w), F.lit(0)))
        on = _same(by, "_c") & (F.col("_rank") >= F.col("_less")) & (F.col("_rank") < F.col("_less") + F.col("_m"))
        on = on & (F.col("_above") == F.col("_prefix")) if k else on
        targets = checkpointed(targets.join(counts, on).select(*by, "share", "_part", "_end", (F.col("_rank") - F.col("_less")).alias("_rank"), F.col("_found").alias("_prefix")))
    told = targets.withColumn("_value", from_bits("_prefix")).groupBy(*by, "share").agg(
        F.max("_part").alias("_part"), F.max(F.when(F.col("_end") == 0, F.col("_value"))).alias("_low"), F.max(F.when(F.col("_end") == 1, F.col("_value"))).alias("_high")
    )
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    return told.select(*by, "share", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias("quantile"))
