"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

A document is cut into pieces of ``capacity`` words at most.  Full pieces fill a bin of their
own; each last piece is packed: pieces come in order of falling size, and a piece goes to the
open bin with the least room that still holds it and has neither a document of its source nor
one of its duplicate cluster.  Open bins are kept in order of their room and carry two bitmaps
(sources, clusters); the search starts at the first bin with room enough and goes on to its
successors until a compatible one is found, else a bin is opened.  Nothing is dropped.

Pieces are dealt to blocks by a hash of the row and its running number among equal rows,
``block_rows`` on average, and each block is packed by one task; sources and clusters of any
size are spread over all blocks, and the result doesn't depend on how the table is partitioned.

Cases: null source or null text conflict with nothing by source or cluster; empty and null
texts are pieces of 0 words; repeated rows are packed each for itself (a repeated document is
its own duplicate, so its copies get different bins); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import count_words, documents, running_number

CAPACITY = 2048
BLOCK_ROWS = 4096
OUT = "doc_id long, piece int, first_word long, n_words int, bin_id string, position int, source string, cluster string"


class Bins:
    """Open bins in order of room, with bitmaps of 64-bit words over the block's sources and clusters."""

    def __init__(self, capacity: int, n_sources: int, n_clusters: int) -> None:
        self.capacity = capacity
        self.room = np.empty(0, np.int64)  # sorted
        self.bin = np.empty(0, np.int64)  # bin number at each place of room
        self.sources = np.zeros((64, n_sources // 64 + 1), np.uint64)
        self.clusters = np.zeros((64, n_clusters // 64 + 1), np.uint64)
        self.count = 0

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin that takes a piece; source and cluster are numbers, or -1 for none."""
        k, found, span = int(np.searchsorted(self.room, size)), -1, 32
        while k < len(self.room):  # successors, in spans that grow
            some = self.bin[k : k + span]
            clash = np.zeros(len(some), bool)
            if source >= 0:
                clash |= (self.sources[some, source >> 6] >> np.uint64(source & 63) & np.uint64(1)).astype(bool)
            if cluster >= 0:
                clash |= (self.clusters[some, cluster >> 6] >> np.uint64(cluster & 63) & np.uint64(1)).astype(bool)
            if not clash.all():
                k += int(clash.argmin())
                found = int(self.bin[k])
                break
            k, span = k + span, span * 2
        if found < 0:
            found, room = self.count, self.capacity
            self.count += 1
            if found >= len(self.sources):
                self.sources = np.concatenate([self.sources, np.zeros_like(self.sources)])
                self.clusters = np.concatenate([self.clusters, np.zeros_like(self.clusters)])
        else:
            room = int(self.room[k])
            self.room, self.bin = np.delete(self.room, k), np.delete(self.bin, k)
        at = int(np.searchsorted(self.room, room - size))
        self.room, self.bin = np.insert(self.room, at, room - size), np.insert(self.bin, at, found)
        if source >= 0:
            self.sources[found, source >> 6] |= np.uint64(1 << (source & 63))
        if cluster >= 0:
            self.clusters[found, cluster >> 6] |= np.uint64(1 << (cluster & 63))
        return found


def pack_block(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece, in the given order.  Clusters of one piece need no bit and are -1."""
    bins = Bins(capacity, int(sources.max(initial=-1)) + 1, int(clusters.max(initial=-1)) + 1)
    return np.array([bins.place(int(a), int(b), int(c)) for a, b, c in zip(sizes, sources, clusters)], np.int64)


def _numbers(values: list, least: int = 1) -> np.ndarray:
    """A number for each value that occurs `least` times or more; -1 for null and the rest."""
    count: dict = {}
    for v in values:
        if v is not None:
            count[v] = count.get(v, 0) + 1
    number = {v: i for i, v in enumerate(v for v, n in count.items() if n >= least)}
    return np.array([number.get(v, -1) for v in values], np.int64)


def pack(docs: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, cluster: str | None = None) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text, source); cluster: a column, else equal texts are a cluster."""
    same = F.col(cluster).cast("string") if cluster else F.when(F.length("text") > 0, F.md5(F.col("text").cast("binary")))
    rows = docs.select("doc_id", "source", same.alias("_cluster"), count_words(F.col("text")).alias("_n"), F.xxhash64("doc_id", "text").alias("_h"))
    # Rows that repeat wholly would share a block; their running numbers deal them, the same however the table is partitioned.
    rows = running_number(rows, ["doc_id", "source", "_cluster", "_h"], "_turn")
    blocks = max(1, -(-rows.count() // block_rows))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_h", "source", "_cluster", "_turn"), F.lit(blocks)))

    def run(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, sort_keys=[("_n", "descending"), *[(c, "ascending") for c in ("doc_id", "_h", "source", "_cluster", "_turn")]])
        t = table.take(order).to_pydict()
        n = np.array(t["_n"], np.int64)
        full, last = n // capacity, n % capacity
        whole = (full > 0) & (last == 0)  # the last piece is full too
        full[whole] -= 1
        last[whole] = capacity
        again = np.argsort(-last, kind="stable")
        bins = np.empty(len(n), np.int64)
        sources, clusters = _numbers(t["source"]), _numbers(t["_cluster"], 2)
        bins[again] = pack_block(last[again], sources[again], clusters[again], capacity)
        held: dict[int, int] = {}
        position = np.empty(len(n), np.int64)
        for i in again:
            position[i] = held[bins[i]] = held.get(bins[i], -1) + 1
        block, extra = t["_block"][0], int(bins.max()) + 1
        out: dict[str, list] = {k.split()[0]: [] for k in OUT.split(", ")}
        for i in range(len(n)):
            pieces = [(k, k * capacity, capacity, extra + k, 0) for k in range(int(full[i]))]
            extra += int(full[i])
            pieces.append((int(full[i]), int(full[i]) * capacity, int(last[i]), int(bins[i]), int(position[i])))
            for k, first, size, b, at in pieces:
                for name, v in zip(out, (t["doc_id"][i], k, first, size, f"{block}-{b}", at, t["source"][i], t["_cluster"][i])):
                    out[name].append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds)})

    return rows.groupBy("_block").applyInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("cluster")
