"""Structured Streaming front end: each run's state machine as a stateful operator over micro-batches.

Rows carry their arrival number t; a batch is learned in order of t, rows at or before the last
learned t are counted and left out (the late-data rule).  The state is one blob for each run, so any
split of a stream into batches gives the trace of a single batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import StreamConfig
from ..kernels.methods import AdaptiveMethod

OUT = "run string, t long, mc_id long, rank int, prob double, accepted boolean, error double, updated boolean, late long"


def learn_stream(rows: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """rows: a stream (run, t, features).  A trace row for each row, by the configuration of its run."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name = key[0]
        if state.exists:
            method, scaler, last, late = pickle.loads(state.get[0])
        else:
            method, scaler, last, late = AdaptiveMethod(StreamConfig.flat(**configs[name])), RunningScale(), -1, 0
        pdf = pd.concat(list(batches)).sort_values("t", kind="stable").drop_duplicates("t")
        fresh = pdf[pdf["t"] > last]
        late += len(pdf) - len(fresh)
        out = []
        for t, x in zip(fresh["t"], fresh["features"]):
            mc, s = method.learn(scaler.scale(np.asarray(x, np.float64)))
            out.append((name, int(t), mc, s.rank, s.prob, s.accepted, s.error, s.updated, late))
            last = int(t)
        state.update((pickle.dumps((method, scaler, last, late)),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return rows.groupBy("run").applyInPandasWithState(step, OUT, "state binary", "append", GroupStateTimeout.NoTimeout)


class RunningScale:
    """Causal standardization that carries count, mean and spread between batches."""

    def __init__(self, eps: float = 1e-8) -> None:
        self.n, self.mean, self.m2, self.eps = 0, 0.0, 0.0, eps

    def scale(self, x: np.ndarray) -> np.ndarray:
        off = x - self.mean
        out = off if self.n < 2 else off / np.sqrt(self.m2 / (self.n - 1) + self.eps)
        self.n += 1
        self.mean = self.mean + off / self.n
        self.m2 = self.m2 + off * (x - self.mean)
        return np.nan_to_num(out)


def stream_files(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """A stream over Parquet files of a folder, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream over what is there, into Parquet, and ends."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
