"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal updates.

A text's n-grams: words and word pairs as they stand, and delexicalised ones, in which a
word is replaced by its outline (runs of upper case, lower case, digits and marks) and by
how far back it occurred last, if that is within four words; those as single tokens, pairs
and triples.  N-grams hash into ``2**bits`` weights; a text's vector is the share of each
n-gram among all of its kind, and its score the logistic function of a sparse dot product.

The model is fitted on a bounded sample (``MAX_ROWS`` rows and ``MAX_BYTES`` bytes of labelled
texts outside the held-out fold); scoring streams every whole text in slices of a few MB.

Cases: null and empty texts have no n-grams and get the bias's score; without labelled rows
all scores are 0; null or repeated ids are scored row by row; labels that repeat for an id
count once (the larger); empty tables give no rows; other columns pass through `score`, whose
own column gets underscores put before it where an input column is called so.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .training import bounded_sample
from .words import HashMemo, chunks, crc32_mod, documents, mix, scramble, texts_of, unused

BITS = 20
MAX_ROWS, MAX_BYTES = 4000, 24 << 20
HELD_OUT = (3, 1)  # modulus and the remainder that is held out
_RUNS = (re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+"))


class OutlineMemo(HashMemo):
    """word -> index into hashes of the word and of its outline."""

    def __init__(self) -> None:
        super().__init__()
        self.word, self.outline = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        shape = _RUNS[0].sub(b"A", word)
        shape = _RUNS[1].sub(b"a", shape)
        shape = _RUNS[2].sub(b"0", shape)[:12]
        self.word.append(zlib.crc32(word) << 20 ^ zlib.crc32(word[::-1]))
        self.outline.append(zlib.crc32(shape, 7) << 20)
        self[word] = at = len(self.word) - 1
        return at

    def arrays(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        out = np.frombuffer(self.word, np.uint64)[at], np.frombuffer(self.outline, np.uint64)[at]
        if len(self.word) > 300_000:
            self.clear()
            self.word, self.outline = array("Q"), array("Q")
        return out


def features(texts: list[bytes], memo: OutlineMemo, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: (slot of each n-gram, text it belongs to)."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    h, o = memo.arrays([w for ws in split for w in ws])
    h = scramble(h, 11)
    back = np.zeros(len(h), np.uint64)
    for lag in (4, 3, 2, 1):
        same = (h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])
        back[lag:][same] = lag
    o = scramble(o + back, 13)
    shift = np.uint64(64 - bits)
    kinds = [(h, doc), (o, doc)]
    for x, seed in ((h, 101), (o, 103)):
        inside = doc[1:] == doc[:-1]
        two = mix(x[:-1], x[1:], seed)
        kinds.append((two[inside], doc[1:][inside]))
    inside = doc[2:] == doc[:-2]
    kinds.append((mix(mix(o[:-2], o[1:-1], 103), o[2:], 107)[inside], doc[2:][inside]))
    return [(((x * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), d) for x, d in kinds]


def dots(texts: list[bytes], weights: np.ndarray, memo: OutlineMemo, bits: int = BITS) -> np.ndarray:
    """The sparse dot product of each text's vector with the weights."""
    out = np.zeros(len(texts))
    for slot, doc in features(texts, memo, bits):
        n = np.bincount(doc, minlength=len(texts))
        out += np.bincount(doc, weights=weights[slot], minlength=len(texts)) / np.maximum(n, 1)
    return out


def fit_ftrl(rows: list[tuple[bytes, object]], bits: int = BITS, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05) -> tuple[np.ndarray, float]:
    """(weights, bias) after FTRL-proximal passes over the rows in order."""
    memo, vectors = OutlineMemo(), []
    for text, label in rows:
        parts = []
        for slot, _ in features([text], memo, bits):
            at, n = np.unique(slot, return_counts=True)
            parts.append((at, n / max(len(slot), 1)))
        at = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
        x = np.concatenate([p[1] for p in parts]) if parts else np.empty(0)
        at, inv = np.unique(at, return_inverse=True)
        vectors.append((at, np.bincount(inv, weights=x, minlength=len(at)), int(label)))
    w, z, n = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)
    b = zb = nb = 0.0
    for _ in range(epochs):
        for at, x, y in vectors:
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            b = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(wi @ x + b, -35, 35))) - y
            gx = g * x
            z[at] = zi + gx - (np.sqrt(ni + gx * gx) - np.sqrt(ni)) / alpha * wi
            n[at] = ni + gx * gx
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w.astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float] | None:
    """The model, or None without a labelled row outside the held-out fold."""
    ids = labels.select("doc_id", label).where(crc32_mod(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1])
    rows = bounded_sample(docs, ids, label, max_rows, max_bytes)
    return fit_ftrl(rows) if rows else None


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """docs with _score (double, 0 to 1) added at the end; every whole text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats, whatever the tables' size
    schema = T.StructType([*docs.schema.fields, T.StructField(unused(docs.columns, "_score")[0], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = OutlineMemo()
        for part in chunks(batches, "text"):
            if shared.value is None:
                p = np.zeros(part.num_rows)
            else:
                w, b = shared.value
                p = 1 / (1 + np.exp(-np.clip(dots(texts_of(part.column("text")), w, memo) + b, -35, 35)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = crc32_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    return score(docs, model).select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
