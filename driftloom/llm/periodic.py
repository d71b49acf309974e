"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of consecutive words with smallest period q and at least ``max(LEAST, 2 q)`` words that no
neighbour extends.  The texts of a slice are taken together, as one sequence with separators of their own:

1.  *Candidates.*  Every word of a run lies in a window of ``LEAST / 2`` words that occurs again in the text, one
    period on or back, as the run is no shorter than ``LEAST`` and two periods.  Stretches covered by windows that
    occur twice or more in their text therefore hold every run whole; only these are analysed.  (An exact filter:
    texts without repeats cost one hash a window.)
2.  *Suffix tree.*  Names of blocks of 1, 2, 4, ... words give the suffix order, common extensions in
    either direction, and with them the tree's intervals: a node is the range of leaves that share a prefix.
3.  *Lempel-Ziv blocks* from the longest earlier factor of each position.  Extensions at the borders of
    each block and its neighbour give a leftmost-covering set of squares.
4.  *Suffix-link walks.*  From each covering square with a primitive root, the link from the leaf of i to that of
    i + 1 is followed while the next word continues the period; each step marks the node of the rotated square.
    The marked nodes are the vocabulary of squares.
5.  *Runs.*  The leaves under each marked node are all places of its square.  Places of one period that follow each
    other are merged.

Everything is vectors over a slice of bounded text (one row at least), so memory follows the slice,
about 200 bytes for each word of candidate stretches and level; nothing is shuffled.

Cases: null, empty and blank texts have no words and no runs; words are compared as bytes; ids may be null or
repeated (rows are judged on their own); texts of any length are taken whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import chunks, documents, texts_of, unused, window_hashes, word_array

LEAST = 12
PART = 1 << 17  # extensions at a time


class Suffixes:
    """Suffix order and common extensions of a sequence of small integers whose first and last entries occur once."""

    def __init__(self, s: np.ndarray) -> None:
        n = len(s)
        self.n, self.names = n, []
        name = np.unique(s, return_inverse=True)[1].astype(np.int64)
        width = 1
        while True:
            self.names.append(name.astype(np.int32))
            if int(name.max()) == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: n - width] = name[width:] + 1
            name = np.unique(name * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            width *= 2
        self.rank = self.names[-1]
        self.order = np.empty(n, np.int32)
        self.order[self.rank] = np.arange(n, dtype=np.int32)
        low = np.zeros(n, np.int32)  # common prefix of each leaf and the one before it
        low[1:] = self.ahead(self.order[:-1], self.order[1:])
        self.lows = [low]
        span = 1
        while 2 * span <= n:
            a = self.lows[-1]
            self.lows.append(np.minimum(a[: len(a) - span], a[span:]))
            span *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension to the right of positions i and j (different ones)."""
        i, j, out = i.astype(np.int64), j.astype(np.int64), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            step = (self.names[k][i + out] == self.names[k][j + out]).astype(np.int64)
            out += step << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension to the left, i and j included; -1 stands before the sequence."""
        i, j, out = i.astype(np.int64), j.astype(np.int64), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            step = (np.minimum(a, b) >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])
            out += step.astype(np.int64) << k
        return out

    def node(self, i: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf of those that share their first ``depth`` entries with i."""
        first = self.rank[i].astype(np.int64)
        last = first.copy()
        for k in range(len(self.lows) - 1, -1, -1):
            t, span = self.lows[k], 1 << k
            at = first - span + 1
            first -= np.where((at >= 1) & (t[np.clip(at, 0, len(t) - 1)] >= depth), span, 0)
            at = last + 1
            last += np.where((at + span <= self.n) & (t[np.minimum(at, len(t) - 1)] >= depth), span, 0)
        return first, last

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks, and the end."""
        order, n = self.order.tolist(), self.n
        before, after = [-1] * n, [-1] * n  # nearest leaves with an earlier position, on either side
        stack: list[int] = []
        for p in order:
            while stack and stack[-1] > p:
                after[stack.pop()] = p
            before[p] = stack[-1] if stack else -1
            stack.append(p)
        longest = np.zeros(n, np.int64)
        for other in (np.array(before), np.array(after)):
            has = np.flatnonzero(other >= 0)
            longest[has] = np.maximum(longest[has], self.ahead(has, other[has]))
        steps, at, out = np.maximum(longest, 1).tolist(), 0, []
        while at < n:
            out.append(at)
            at += steps[at]
        return np.array([*out, n], np.int64)


def _counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry k of n, k repeated n[k] times, and the numbers from 0 to n[k] - 1."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _parts(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_counted in parts of about PART."""
    slot = np.cumsum(n) // PART
    for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(n)], cuts[1:]):
        which, number = _counted(n[a:b])
        yield which + a, number


def covering(x: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and root lengths of squares that cover the leftmost place of every square, from the borders of the blocks."""
    h = x.blocks()
    size = np.diff(h)
    following = np.append(size[1:], 0)
    starts, roots = [], []
    for which, k in _parts(np.where(h[1:] < x.n, size, 0)):  # from the block's end back into it
        k, end = k + 1, h[which + 1]
        q = end - k
        right, left = x.ahead(end, q), x.behind(end - 1, q - 1)
        found = (right > 0) & (right + left >= k)
        starts.append(np.maximum(q - left, q - k + 1)[found])
        roots.append(k[found])
    for which, k in _parts(np.minimum(size + following, x.n - 1 - h[:-1])):  # across the block's beginning
        k, begin = k + 1, h[which]
        q = begin + k
        right, left = x.ahead(begin, q), x.behind(begin - 1, q - 1)
        at = np.maximum(begin - left, begin - k + 1)
        found = (right > 0) & (left > 0) & (right + left >= k) & (at + k <= h[which + 1])
        starts.append(at[found])
        roots.append(k[found])
    return np.concatenate(starts or [np.empty(0, np.int64)]), np.concatenate(roots or [np.empty(0, np.int64)])


def _primitive(x: Suffixes, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the k entries from i are no power of a shorter sequence."""
    out, rest, prime = np.ones(len(i), bool), k.copy(), 2
    while len(i) and prime <= int(rest.max()):
        if prime * prime > int(rest.max()):  # what is left of each k is 1 or a prime
            hit, p = np.flatnonzero(rest > 1), rest
        else:
            hit, p = np.flatnonzero(rest % prime == 0), np.full(len(k), prime)
        if len(hit):
            d = k[hit] // p[hit]
            out[hit] &= x.ahead(i[hit], i[hit] + d) < k[hit] - d
            if p is rest:
                break
            while len(hit := hit[rest[hit] % prime == 0]):
                rest[hit] //= prime
        prime += 1 if prime == 2 else 2
    return out


def sequence_runs(s: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of the runs of ``least`` entries or more of a sequence whose first and last entries occur once."""
    x = Suffixes(s)
    i, k = covering(x)
    pair = np.unique(k * x.n + i)
    i, k = pair % x.n, pair // x.n
    good = _primitive(x, i, k)
    i, k = i[good], k[good]
    steps = x.ahead(i, i + k) - k + 1  # the walk: as long as the next entry continues the period
    marked = [np.empty((0, 3), np.int64)]
    for which, step in _parts(steps):
        first, last = x.node(i[which] + step, 2 * k[which])
        marked.append(np.unique(np.stack([k[which], first, last], 1), axis=0))
    words = np.unique(np.concatenate(marked), axis=0)
    which, number = _counted(words[:, 2] - words[:, 1] + 1)
    places = np.unique(words[which, 0] * x.n + x.order[words[which, 1] + number])
    if not len(places):
        return np.empty((0, 3), np.int64)
    edge = np.flatnonzero(np.diff(places) != 1)  # neither a gap nor the next period
    begin, end = places[np.append(0, edge + 1)], places[np.append(edge, len(places) - 1)]
    period, start = begin // x.n, begin % x.n
    length = end - begin + 2 * period
    keep = length >= least
    return np.stack([start, length, period], 1)[keep]


def text_runs(codes: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of the runs of many texts one after the other, by start and period.

    codes are numbers for words, ends the end of each text; starts count from the first text's beginning.
    """
    width = least // 2
    none = np.empty((0, 3), np.int64)
    if len(codes) < least:
        return none
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    own = np.flatnonzero(owner[: len(codes) - width + 1] == owner[width - 1 :])  # windows inside one text
    key = window_hashes(codes.astype(np.uint64), width, 11)[own] ^ (owner[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return none
    at = own[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
    cut = np.flatnonzero((np.diff(at) > width) | (np.diff(owner[at]) != 0)) + 1
    begin, end = at[np.append(0, cut)], at[np.append(cut, len(at)) - 1] + width
    begin, end = begin[end - begin >= least], end[end - begin >= least]
    if not len(begin):
        return none
    which, number = _counted(end - begin + 1)  # each stretch and a separator before it
    s = codes[np.minimum(begin[which] + number - 1, len(codes) - 1)].astype(np.int64)
    top = int(codes.max()) + 1
    s[number == 0] = top + np.arange(len(begin))
    s = np.append(s, top + len(begin))
    found = sequence_runs(s, least)
    shift = begin - np.flatnonzero(number == 0) - 1
    found[:, 0] += shift[which[found[:, 0]]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


RUNS = T.ArrayType(T.StructType([T.StructField(x, T.LongType(), False) for x in ("start", "length", "period")]), False)


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with _runs (start in words, length and period of each, by start, then period) and _collapsed: the
    words, joined by one space, without those that a run contains after its first period."""
    words, collapsed = unused(docs.columns, "_runs", "_collapsed")
    schema = T.StructType([*docs.schema, T.StructField(words, RUNS, False), T.StructField(collapsed, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            texts = [x.split() for x in texts_of(part.column("text"))]
            index: dict[bytes, int] = {}
            ends = np.cumsum([len(x) for x in texts])
            codes = np.fromiter((index.setdefault(w, len(index)) for x in texts for w in x), np.int64, int(ends[-1]))
            found = text_runs(codes, ends, least)
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, found[:, 0] + found[:, 2], 1)
            np.add.at(change, found[:, 0] + found[:, 1], -1)
            kept = np.cumsum(change) == 0
            owner = np.searchsorted(ends, found[:, 0], "right")
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            starts = ends - [len(x) for x in texts]
            joined = []
            for k, x in enumerate(texts):
                if bounds[k] < bounds[k + 1]:
                    x = [w for w, ok in zip(x, kept[starts[k] : ends[k]].tolist()) if ok]
                joined.append(b" ".join(x))
            rows = pa.StructArray.from_arrays([found[:, 0] - starts[owner], found[:, 1], found[:, 2]], [f.name for f in RUNS.elementType])
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows)
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(joined, pa.binary()).cast(pa.string())], schema.names)

    return docs.mapInArrow(run, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's input: in one text of ten, by the id's checksum, the words from some place on repeat with a period.  Texts of null ids stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def spun(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.transform(places, lambda i: F.get(words, i))

    # The words are bound to a variable: written into the lambda, they would be split anew for each word.
    changed = F.get(F.transform(F.array(word_array(text)), lambda words: F.array_join(spun(words), " ")), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), changed).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.get(F.sort_array(F.transform("_runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))), F.lit(0))
    lines = F.transform("_runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("_runs") == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    return found.select("doc_id", F.size("_runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("_collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        F.col("_best.start").alias("start"),
        (-F.col("_best.col1")).alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * -_best.col1 div _best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
