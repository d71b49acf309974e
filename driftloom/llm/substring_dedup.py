"""Substring deduplication: a count-min prefilter, then exact grouping of what it lets through.

A window is ``width`` consecutive words of one document.  Each word is removed that lies in a
window whose word sequence also starts earlier (smaller id, or same document further left),
judged on the input.

Documents are dealt to blocks of about ``block_bytes`` by a hash of their id; one shuffle of the
texts is shared by three rounds, in which only digests travel:

1.  Each block makes the count-min sketch of its windows in sparse form (sorted distinct 32-bit
    keys, delta coded, about two bytes a window), cut into shards by hash.  A shard's task adds up
    the partial sketches of all blocks into ``DEPTH`` rows of counters; estimates never fall below
    the true counts.  It answers each block with one bit for each key: estimated repeated or not.
2.  Each block sends its first occurrence of every window estimated repeated (128-bit hash, id,
    position) to the shard of its hash.  There equal windows of all blocks are grouped exactly, the
    earliest keeps its words, and every other block learns which of its firsts come later.
3.  Each block marks those and its own repeats, and drops the words they cover.

No sketch is ever broadcast or held whole: a shard has about ``shard_windows`` windows at any
size of input.  A window of a third of all documents sends one entry for each block; beyond
``SPAN`` blocks those of each range of blocks meet first, and one entry for each range goes on.
Equality of windows is equality of 128-bit hashes (two independent combinations of 64-bit word hashes).

Cases: null and empty texts have no words and keep nothing (the digest of the empty text); texts
shorter than a window lose nothing; rows without an id come last in order; rows that repeat an
id are ordered by text, equal rows arbitrarily (the first keeps its words); an empty table gives
no rows; further columns pass through `dedup`, whose own columns get underscores put before
them where an input column is called so; all rows of one id are in one block.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import HashMemo, checkpointed, documents, give_back, scramble, texts_of, unused, window_hashes

WIDTH = 20
BLOCK_BYTES = 2 << 20
SHARD_WINDOWS = 1 << 20
SPAN = 4096  # blocks whose windows meet in one task
DEPTH = 2
COUNTERS = 1 << 22  # in each row of a shard's sketch
LAST = np.iinfo(np.int64).max
PACKED = "shard int, block long, n int, data binary"
REPLY = "block long, shard int, data binary"
TOLD = "block long, shard int, n int, data binary"
BLOCK = "_block of substring dedup"  # the one name that a column of the input may not have
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def squeeze(*columns: np.ndarray) -> bytes:
    """Arrays of fixed-width integers as one compressed string: bytes of equal weight lie together."""
    return zlib.compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns), 1)


def unsqueeze(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zlib.decompress(data), np.uint8), [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


class Block:
    """Words and windows of the documents of one block, in the order that decides which window is first."""

    def __init__(self, table: pa.Table, width: int, both: bool = True) -> None:
        keys = [("doc_id", "ascending"), ("text", "ascending")]
        self.table = table.take(pa.compute.sort_indices(table, sort_keys=keys, null_placement="at_end")) if table.num_rows > 1 else table
        self.words = [t.split() for t in texts_of(self.table.column("text").combine_chunks())]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.doc = np.repeat(np.arange(len(self.words)), self.sizes)
        h = HashMemo().hashes([w for ws in self.words for w in ws])
        a = window_hashes(h, width, 0x51ED)
        self.start = np.flatnonzero(self.doc[: len(a)] == self.doc[width - 1 :][: len(a)])
        self.a = a[self.start]
        self.b = window_hashes(h, width, 0xA7C3F)[self.start] if both else None

    def ids(self) -> np.ndarray:
        return self.table.column("doc_id").cast(pa.int64()).combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)

    def keys(self, shards: int) -> np.ndarray:
        """shard and 32-bit key of each window, in one number."""
        return ((self.a >> np.uint64(32)) % np.uint64(shards)) << np.uint64(32) | (self.a & np.uint64(0xFFFFFFFF))


def _split(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys."""
    shard = (keys >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(keys) else []
    return [(int(shard[i]), int(i), int(j)) for i, j in zip(cuts[:-1], cuts[1:])]


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)})


_TOLD = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
_PACKED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])
_REPLY = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])


def partial_sketch(table: pa.Table, width: int, shards: int) -> pa.Table:
    """Round 1, block: its sketch in sparse form, by shard."""
    block = Block(table, width, both=False)
    keys, count = np.unique(block.keys(shards), return_counts=True)
    number, out = table.column(BLOCK)[0].as_py(), []
    for shard, i, j in _split(keys):
        low = (keys[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out.append((shard, number, j - i, zlib.compress(squeeze(deltas(low)) + np.packbits(count[i:j] > 1).tobytes(), 0)))
    return _rows(_PACKED, out)


def _decode_keys(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    bits = (n + 7) // 8
    (low,) = unsqueeze(raw[:-bits], n, np.uint32)
    return np.cumsum(low, dtype=np.uint32), np.unpackbits(np.frombuffer(raw[-bits:], np.uint8), count=n).astype(bool)


def merged_sketch(table: pa.Table, counters: int = COUNTERS, depth: int = DEPTH) -> pa.Table:
    """Round 1, shard: adds the partial sketches up, and tells each block which of its keys are estimated repeated."""
    t = table.select(["shard", "block", "n", "data"]).to_pydict()
    parts = [_decode_keys(n, d) for n, d in zip(t["n"], t["data"])]
    keys = np.concatenate([p[0] for p in parts]).astype(np.uint64)
    adds = 1 + np.concatenate([p[1] for p in parts]).astype(np.uint8)
    estimate = np.full(len(keys), 255, np.uint8)
    for row in range(depth):
        cell = (scramble(keys, 0x9D + 0x1F * row) & np.uint64(counters - 1)).astype(np.int64)
        total = np.minimum(np.bincount(cell, weights=adds, minlength=counters), 255).astype(np.uint8)
        estimate = np.minimum(estimate, total[cell])
    out, at = [], 0
    for shard, block, n in zip(t["shard"], t["block"], t["n"]):
        out.append((block, shard, zlib.compress(np.packbits(estimate[at : at + n] > 1).tobytes(), 1)))
        at += n
    return _rows(_REPLY, out)


def candidates(table: pa.Table, replies: pa.Table, width: int, shards: int) -> pa.Table:
    """Round 2, block: the first occurrences of the windows estimated repeated, by shard."""
    if not table.num_rows or not replies.num_rows:
        return _rows(_PACKED, [])
    block = Block(table, width)
    keys, inverse = np.unique(block.keys(shards), return_inverse=True)
    said = {s: d for s, d in zip(replies.column("shard").to_pylist(), replies.column("data").to_pylist())}
    flag = np.zeros(len(keys), bool)
    for shard, i, j in _split(keys):
        flag[i:j] = np.unpackbits(np.frombuffer(zlib.decompress(said[shard]), np.uint8), count=j - i).astype(bool)
    at = np.flatnonzero(flag[inverse])
    a, b = block.a[at], block.b[at]
    shard = (a >> np.uint64(32)) % np.uint64(shards)
    order = np.lexsort((b, a, shard))  # stable: equal windows stay in order of their place
    a, b, at, shard = a[order], b[order], at[order], shard[order].astype(np.int64)
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, at, shard = a[first], b[first], at[first], shard[first]
    ids = block.ids()[block.doc[block.start[at]]]
    number, out = table.column(BLOCK)[0].as_py(), []
    for s in np.unique(shard):
        i, j = np.searchsorted(shard, (s, s + 1))
        out.append((int(s), number, int(j - i), squeeze(deltas(a[i:j]), b[i:j], ids[i:j], at[i:j].astype(np.uint32))))
    return _rows(_PACKED, out)


Firsts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # hash, other hash, id, position, block


def _firsts(t: pa.Table) -> Firsts:
    """The windows that blocks sent, or (block numbers below 0) ranges of blocks."""
    parts = []
    for n, block, d in zip(t.column("n").to_pylist(), t.column("block").to_pylist(), t.column("data").to_pylist()):
        if block >= 0:
            a, b, ids, at = unsqueeze(d, n, np.uint64, np.uint64, np.int64, np.uint32)
            parts.append((np.cumsum(a, dtype=np.uint64), b, ids, at, np.full(n, block, np.int64)))
        else:
            a, *rest = unsqueeze(d, n, np.uint64, np.uint64, np.int64, np.uint32, np.int64)
            parts.append((np.cumsum(a, dtype=np.uint64), *rest))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(5))


def owners(table: pa.Table, ahead: bool = False) -> pa.Table:
    """Round 2, shard: exact groups of equal windows; tells each block which of its firsts come after another one's.

    ahead: the table is of a range of blocks, whose earliest windows go on (as a row with a block number below 0).
    """
    shard = table.column("shard")[0].as_py()
    a, b, ids, at, block = _firsts(table)
    order = np.lexsort((block, ids, b, a))
    later = np.zeros(len(a), bool)
    later[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    first, order = order[~later], order[later]
    order = order[np.lexsort((at[order], block[order]))]
    out = []
    for k in np.unique(block[order]):
        i, j = np.searchsorted(block[order], (k, k + 1))
        out.append((int(k), shard, int(j - i), squeeze(deltas(at[order[i:j]]))))
    if ahead:
        out.append((-1 - table.column("span")[0].as_py(), shard, len(first), squeeze(deltas(a[first]), b[first], ids[first], at[first], block[first])))
    return _rows(_TOLD, out)


def cut(text: bytes, gone: list[bool]) -> bytes:
    """text without the words marked gone and the white space after each of them."""
    out, at = [], 0
    for m, off in zip(_WORD.finditer(text), gone):
        if off:
            out.append(text[at : m.start()])
            at = m.end()
    return b"".join([*out, text[at:]])


def removal(table: pa.Table, replies: pa.Table, width: int, names: list[str], joined: bool) -> pa.Table:
    """Round 3, block: every document with its number of words, of removed words, and what is kept of its text."""
    block = Block(table, width)
    order = np.lexsort((block.b, block.a))
    again = np.zeros(len(order), bool)
    a, b = block.a[order], block.b[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    again[order[1:][same]] = True
    for n, d in zip(replies.column("n").to_pylist(), replies.column("data").to_pylist()):
        (x,) = unsqueeze(d, n, np.uint32)
        again[np.cumsum(x, dtype=np.uint32)] = True
    edge = np.zeros(len(block.doc) + 1, np.int32)
    np.add.at(edge, block.start[again], 1)
    np.add.at(edge, block.start[again] + width, -1)
    gone = np.cumsum(edge)[:-1] > 0
    removed = np.bincount(block.doc[gone], minlength=len(block.words))
    first, kept = np.cumsum(block.sizes) - block.sizes, []
    texts = None if joined else texts_of(block.table.column("text").combine_chunks())
    valid = block.table.column("text").is_valid().to_pylist()
    for i, words in enumerate(block.words):
        off = gone[first[i] : first[i] + len(words)].tolist() if removed[i] else []
        if joined:
            kept.append(b" ".join([w for w, x in zip(words, off) if not x] if off else words))
        else:
            kept.append(cut(texts[i], off) if off else texts[i] if valid[i] else None)
    out = block.table.drop_columns([BLOCK])
    columns = (pa.array(block.sizes), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string()))
    for name, column in zip(names, columns):
        out = out.append_column(name, column)
    return out


def _then_free(table: pa.Table) -> pa.Table:
    give_back()
    return table


def dedup(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, shard_windows: int = SHARD_WINDOWS, joined: bool = True, span: int = SPAN) -> DataFrame:
    """docs (doc_id, text, ...) with _n_words, _n_removed (long) and _kept (string) added at the end.

    _kept: the words kept, joined by one space, or (joined=False) the text itself without the removed words
    and the white space after each, so that a text that loses nothing stays as it is.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = max(1, -(-total // block_bytes)), max(1, -(-total // (6 * shard_windows)))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    dealt = docs.withColumn(BLOCK, F.pmod(key, F.lit(blocks)))
    names = unused(docs.columns, "_n_words", "_n_removed", "_kept")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.StringType()))]])
    sketches = dealt.groupBy(BLOCK).applyInArrow(lambda t: _then_free(partial_sketch(t, width, shards)), PACKED)
    repeated = sketches.groupBy("shard").applyInArrow(lambda t: _then_free(merged_sketch(t)), REPLY)
    firsts = dealt.groupBy(BLOCK).cogroup(repeated.groupBy("block")).applyInArrow(lambda t, r: _then_free(candidates(t, r, width, shards)), PACKED)
    if blocks > span:  # first within each range of blocks, then the earliest of all ranges: no window meets all blocks in one task
        ranges = firsts.withColumn("span", F.floor(F.col("block") / span))
        inside = checkpointed(ranges.groupBy("shard", "span").applyInArrow(lambda t: _then_free(owners(t, True)), TOLD))
        across = inside.where(F.col("block") < 0).groupBy("shard").applyInArrow(lambda t: _then_free(owners(t)), TOLD)
        later = inside.where(F.col("block") >= 0).union(across)
    else:
        later = firsts.groupBy("shard").applyInArrow(lambda t: _then_free(owners(t)), TOLD)
    return dealt.groupBy(BLOCK).cogroup(later.groupBy("block")).applyInArrow(lambda t, r: _then_free(removal(t, r, width, names, joined)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM g),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS n FROM k) WHERE n > 1),
x AS (SELECT DISTINCT doc_id, p + i AS p FROM r, (SELECT unnest(range(0, 20)) AS i)),
y AS (SELECT doc_id, list(p) AS gone FROM x GROUP BY doc_id),
z AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
             CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda t: NOT list_contains(gone, t[2])), lambda t: t[1]) END AS kept
      FROM d LEFT JOIN y ON d.doc_id = y.doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM z
"""
