"""Hashed word features."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]{2,}"  # letters and digits of any script


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def md5_slot(gram: bytes, buckets: int) -> int:
    """Slot of a gram by the first eight hexadecimal digits of its md5."""
    return int(hashlib.md5(gram).hexdigest()[:8], 16) % buckets


def murmur3(data: bytes, seed: int = 0) -> int:
    """The 32-bit MurmurHash3 (x86) of some bytes, signed."""
    mask = 0xFFFFFFFF

    def scrambled(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    h, whole = seed, len(data) & ~3
    for i in range(0, whole, 4):
        h ^= scrambled(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if whole < len(data):
        h ^= scrambled(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h - (1 << 32) if h >> 31 else h


def murmur3_slot(gram: bytes, buckets: int) -> int:
    """Slot of a gram as library vectorizers place it."""
    return abs(murmur3(gram)) % buckets


SLOTS = {"md5": md5_slot, "murmur3": murmur3_slot}
MEMO = 200_000


def hashed_features(docs: DataFrame, buckets: int = 2048, mode: str = "md5") -> DataFrame:
    """doc_id, slot, value: counts of hashed words and neighboring pairs as unit vectors, for each row of docs (doc_id, text) by itself.

    Words are found by built-in functions; a row's grams are counted where it lies, in Arrow batches, so nothing
    is shuffled.  Rows without a word give no rows; rows that repeat an id are counted each for itself.
    """
    if mode not in SLOTS:
        raise ValueError(f"unknown mode: {mode}")
    place = SLOTS[mode]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("slot", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def slot(gram: str) -> int:
            at = known.get(gram)
            if at is None:
                if len(known) > MEMO:
                    known.clear()
                at = known[gram] = place(gram.encode(), buckets)
            return at

        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                row, slots, values = [], [], []
                for i, found in enumerate(batch.column("_w").to_pylist()):
                    at, n = np.unique([slot(g) for g in found + [f"{x} {y}" for x, y in zip(found, found[1:])]], return_counts=True)
                    row.append(np.full(len(at), i))
                    slots.append(at)
                    values.append(n / np.sqrt(float(n @ n)) if len(n) else n)
                ids = batch.column("doc_id").take(pa.array(np.concatenate(row).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(slots).astype(np.int32)), pa.array(np.concatenate(values).astype(np.float64))], schema.names)

    return docs.select("doc_id", words(F.col("text")).alias("_w")).mapInArrow(run, schema)
