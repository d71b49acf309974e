"""A coreset of a whole table that keeps its mass: reduced by bucket, then pairs merged and reduced level by level.

Each task sees one bucket of rows, or the representatives of a pair.  Random numbers come from (seed, level,
bucket), so the result is the same however rows lie.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.summaries import represent
from ..session import checkpointed

SIZE, BUCKET = 500, 1000
CUT = 4  # levels between checkpoints, so that a plan doesn't grow with the tree


def _reduced(rows: DataFrame, level: int, size: int, seed: int) -> DataFrame:
    """rows (bucket, t, features, w) with ``size`` rows in each bucket at most."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", kind="stable")
        if len(part) <= size:
            return part
        x, w = np.stack(part["features"].to_numpy()).astype(np.float64), part["w"].to_numpy(np.float64)
        place = np.random.SeedSequence([seed, level, int(key[0])]).generate_state(1)[0]
        reps, mass = represent(x, w, size, int(place))
        return pd.DataFrame({"bucket": key[0], "t": np.arange(len(reps)), "features": list(reps), "w": mass})

    return rows.groupBy("bucket").applyInPandas(run, "bucket long, t long, features array<double>, w double")


def coreset_tree(rows: DataFrame, size: int = SIZE, bucket: int = BUCKET, seed: int = 7) -> DataFrame:
    """place, features, w: ``size`` weighted points at most that stand for all rows (t, features, w); their weights sum to the rows'.

    t: distinct, from 0; buckets are ranges of it.  Rows without features are left out.
    """
    kept = rows.where(F.col("features").isNotNull()).select(F.floor(F.col("t") / bucket).cast("long").alias("bucket"), F.col("t").cast("long").alias("t"), "features", F.col("w").cast("double").alias("w"))
    last = kept.agg(F.max("bucket").alias("b")).first()["b"] or 0
    level, out = 0, _reduced(kept, 0, size, seed)
    while last:
        level, last = level + 1, last >> 1
        # Of a pair the left one's points come first.
        paired = out.select(F.shiftright("bucket", 1).alias("bucket"), (F.col("t") + F.col("bucket").bitwiseAND(1) * bucket).alias("t"), "features", "w")
        out = _reduced(paired, level, size, seed)
        out = checkpointed(out) if level % CUT == 0 else out
    return out.select(F.col("t").alias("place"), "features", "w")
