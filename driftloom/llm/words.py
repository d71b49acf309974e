"""What the text operators share: words, word hashes, bounded chunks of Arrow batches, checkpoints.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``
(``[^\\x20\\x09-\\x0D]+``).  ``bytes.split()`` splits at exactly these bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"
CHUNK_BYTES = 2 << 20
MEMO_WORDS = 200_000


def count_words(text: Column) -> Column:
    """Number of words of a text column, as long; 0 for null and blank texts."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, WS))).cast("long")


def word_array(text: Column) -> Column:
    """The words of a text column in order; an empty array for null and blank texts."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WS))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir.  Only a local session that names none gets a temporary folder; others raise."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="driftloom-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder, so later reads neither recompute nor lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running_number(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with the number, from 0, of each among the rows equal in keys (null equals null).

    The rows are written once.  Numbers are counted within each written partition and moved on by the
    counts of the partitions before it, so no task sees a whole group.  Which of the rows that are
    equal in all columns has which number depends on how they lie, the set of numbers doesn't.
    """
    held = checkpointed(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_at", 33)))
    counts = held.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_start", before).withColumn("_all", F.sum("_n").over(group)).where(F.col("_all") > 1)
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"), "_start")
    same = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_pid").orderBy("_at")) - 1
    many = held.join(starts, same).withColumn(name, (F.col("_start") + inside).cast("long"))
    single = held.join(starts, same, "left_anti").withColumn(name, F.lit(0).cast("long"))
    return single.select(*rows.columns, name).union(many.select(*rows.columns, name))


def unused(columns: list[str], *names: str) -> list[str]:
    """names, each with underscores put before it until no column is called so (in any case of letters)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Returns freed memory to the system: workers are reused, and what one operator held would stay with the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


class HashMemo(dict):
    """word (bytes) -> 64-bit hash, remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = value
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray, c: int) -> np.ndarray:
    """Order-dependent 64-bit combination of two hash arrays."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(c)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def scramble(x: np.ndarray, c: int) -> np.ndarray:
    """Another 64-bit hash of 64-bit hashes."""
    x = (x ^ np.uint64(c)) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def window_hashes(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive entries of h, by doubling: about log2(width) vector steps."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, span, level, covered = None, 1, h, 0
    left = width
    while left:
        if left & span:
            part = level[covered : covered + n]
            out = part.copy() if out is None else mix(out, part, seed + covered)
            covered += span
            left -= span
        if left:
            level = mix(level[:-span], level[span:], seed + 7919 * span)
            span *= 2
    return scramble(out, seed)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` text bytes (one row at least), so that memory doesn't follow the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([x or 0 for x in pa.compute.binary_length(batch.column(text)).to_pylist()], np.int64)
        slot = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def crc32_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text modulo m; the fold of a row.  A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(m)).cast("int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
