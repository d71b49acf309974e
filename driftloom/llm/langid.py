"""Language identification by hierarchical discrimination.

First the family: one linear support vector machine for each family against the rest.
Then, within the family, one-versus-one linear machines separate its languages; the
language with the most votes wins, the larger summed margin deciding ties.  Features are
hashed byte trigrams of the text with A-Z lower-cased (``2**bits`` slots), as counts of unit length.

Families: a written table groups well-known languages.  Any other language joins the family with
the centroid most like its own in the training texts, if their cosine is ``ALIKE`` or more; else it
begins a family, which later ones may join.  A family of more than ``MOST`` languages is divided, again and again, between its two
least alike centroids, so the number of machines grows with the languages, not with their square.

The machines are fitted by dual coordinate descent on a bounded sample (``MAX_ROWS`` rows,
``MAX_BYTES`` bytes).  Their weights are kept by trigram, without zeros; scoring adds up those of all different trigrams
of every whole text.

Cases: null texts and texts without a letter are ``und`` with score 0; without learned
languages every text is ``und``; a single family or language needs no machine and scores
1; null and repeated ids are predicted row by row; empty tables give no rows; other columns
are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .training import bounded_sample
from .words import chunks, crc32_mod, documents, texts_of

BITS = 16
MAX_ROWS, MAX_BYTES = 3000, 16 << 20
HELD_OUT = (3, 1)

ALIKE = 0.6
MOST = 12

# Families of some languages.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b) / max(float(np.linalg.norm(a) * np.linalg.norm(b)), 1e-12)


def divided(langs: list[str], centroids: dict[str, np.ndarray], most: int = MOST) -> list[list[str]]:
    """langs in groups of ``most`` at most: halves around the two least alike centroids, and halves of these."""
    langs = sorted(langs)
    if len(langs) <= most:
        return [langs]
    unit = np.stack([centroids[x] / max(float(np.linalg.norm(centroids[x])), 1e-12) for x in langs])
    like = unit @ unit.T
    a, b = np.unravel_index(int(like.argmin()), like.shape)
    order = np.argsort(like[a] - like[b], kind="stable")  # those nearer to b first
    half = int(np.clip((like[a] < like[b]).sum(), len(langs) // 4, len(langs) - len(langs) // 4))
    return [g for part in (order[:half], order[half:]) for g in divided([langs[i] for i in part], centroids, most)]


def families_of(centroids: dict[str, np.ndarray], most: int = MOST) -> dict[str, str]:
    """language -> family, given the mean vector of each language."""
    out = {x: f for f, langs in FAMILIES.items() for x in langs if x in centroids}
    sums: dict[str, np.ndarray] = {}
    for x, f in out.items():
        sums[f] = sums.get(f, 0) + centroids[x]
    for x in sorted(set(centroids) - set(out)):
        like = {f: _cosine(c, centroids[x]) for f, c in sums.items()}
        best = max(like, key=lambda f: (like[f], f), default=None)
        out[x] = best if best is not None and like[best] >= ALIKE else x
        sums[out[x]] = sums.get(out[x], 0) + centroids[x]
    for f in sorted(set(out.values())):
        groups = divided([x for x, g in out.items() if g == f], centroids, most)
        for k, group in enumerate(groups if len(groups) > 1 else []):
            out |= {x: f"{f}/{k}" for x in group}
    return out


def trigram_slots(text: bytes, bits: int = BITS) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    b[b < 33] = 32
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def fit_svm(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int = BITS, c: float = 20.0, epochs: int = 8) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with hinge loss, y in -1 and 1."""
    w, a = np.zeros((1 << bits) + 1), np.zeros(len(y))
    square = [float(x @ x) + 0.01 for _, x in vectors]
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, x = vectors[i]
            gain = y[i] * (w[at] @ x + 0.1 * w[-1]) - 1
            new = min(max(a[i] - gain / square[i], 0.0), c)
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[at] += step * x
                w[-1] += step * 0.1
                a[i] = new
    w[-1] *= 0.1
    return w


class Model:
    """families, languages of each, and the machines: biases, and for each slot the machines with a weight there."""

    def __init__(self, rows: list[tuple[bytes, object]], bits: int = BITS) -> None:
        self.bits = bits
        langs = np.array([str(label) for _, label in rows])
        self.langs = sorted(set(langs.tolist()))
        vectors, centroids = [], {x: np.zeros(1 << bits) for x in self.langs}
        for text, _ in rows:
            slot = trigram_slots(text, bits)
            at, n = np.unique(slot, return_counts=True)
            vectors.append((at, n / max(np.linalg.norm(n), 1e-9)))
        for (at, x), lang in zip(vectors, langs):
            centroids[lang][at] += x
        family = families_of(centroids)
        self.families = sorted(set(family.values()))
        self.members = {f: [x for x in self.langs if family[x] == f] for f in self.families}
        of = np.array([family[x] for x in langs])
        self.rest, self.pairs = {}, {}
        bias, slots, numbers, weights = [], [], [], []

        def add(w: np.ndarray) -> int:
            at = np.flatnonzero(w[:-1])
            slots.append(at.astype(np.int32))
            numbers.append(np.full(len(at), len(bias), np.int32))
            weights.append(w[at].astype(np.float32))
            bias.append(w[-1])
            return len(bias) - 1

        if len(self.families) > 1:
            for f in self.families:
                self.rest[f] = add(fit_svm(vectors, np.where(of == f, 1.0, -1.0), bits))
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                pick = np.flatnonzero((langs == a) | (langs == b))
                self.pairs[a, b] = add(fit_svm([vectors[i] for i in pick], np.where(langs[pick] == a, 1.0, -1.0), bits))
        slot = np.concatenate([*slots, np.empty(0, np.int32)])
        order = np.argsort(slot, kind="stable")
        self.bias = np.array(bias)
        self.number = np.concatenate([*numbers, np.empty(0, np.int32)])[order]
        self.weights = np.concatenate([*weights, np.empty(0, np.float32)])[order]
        self.begin = np.searchsorted(slot[order], np.arange((1 << bits) + 1))

    def weight(self, slot: int, machine: int) -> float:
        at = slice(self.begin[slot], self.begin[slot + 1])
        return float(self.weights[at][self.number[at] == machine].sum())

    def margins(self, text: bytes) -> np.ndarray:
        """Every machine's margin: the weights of the text's different trigrams times their share of its length."""
        slot, n = np.unique(trigram_slots(text, self.bits), return_counts=True)
        first, size = self.begin[slot], self.begin[slot + 1] - self.begin[slot]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        sums = np.bincount(self.number[at], self.weights[at] * np.repeat(n, size), len(self.bias))
        return sums / max(np.sqrt(float(n @ n)), 1e-9) + self.bias

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        m = np.stack([self.margins(x) for x in texts]) if texts else np.zeros((0, len(self.bias)))
        sure = lambda x: 1 / (1 + np.exp(-2 * np.clip(x, -15, 15)))
        if self.rest:
            margins = np.stack([m[:, self.rest[f]] for f in self.families], 1)
            family, p = margins.argmax(1), sure(margins.max(1))
        else:
            family, p = np.zeros(len(texts), int), np.ones(len(texts))
        out = []
        for i, k in enumerate(family):
            members = self.members[self.families[k]]
            if len(members) == 1:
                out.append(members[0])
                continue
            votes = {x: [0, 0.0] for x in members}
            for a, b in combinations(members, 2):
                d = m[i, self.pairs[a, b]]
                for x, s in ((a, d), (b, -d)):
                    votes[x][0] += s > 0
                    votes[x][1] += s
            best = max(members, key=lambda x: (votes[x][0], votes[x][1]))
            worst = min((m[i, self.pairs[a, b]] * (1 if a == best else -1) for a, b in combinations(members, 2) if best in (a, b)), default=0.0)
            p[i] *= sure(worst)
            out.append(best)
        return out, p


def train(docs: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model | None:
    """docs: (doc_id, text, lang)."""
    ids = docs.select("doc_id", "lang").where(crc32_mod(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1])
    rows = bounded_sample(docs.select("doc_id", "text"), ids, "lang", max_rows, max_bytes)
    return Model(rows) if rows else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            letter = np.array(part.column("_letter").to_pylist(), bool)
            lang, p = [None] * part.num_rows, np.zeros(part.num_rows)
            if shared.value is not None and part.num_rows:
                lang, p = shared.value.predict(texts_of(part.column("text")))
            lang = [x if ok and x else "und" for x, ok in zip(lang, letter)]
            p = np.where([x == "und" for x in lang], 0.0, p)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(p, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc32_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    return predict(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
