"""Token ids of documents in Parquet files that allow selective reads.

``write`` puts documents in ascending order of their ids (ranges of ids are files, sorted within), encodes
each whole text, appends an end id, and writes one row a document: ``doc_id``, ``part`` (the file's
number in order), ``offset`` (ids before the document in its file), ``n_tokens``, and the ids as a
list column.  Ids are dictionary encoded (a vocabulary fits a page), the other
columns are delta encoded; row groups and pages have bounded sizes, and every column chunk has a page
index.  So a read of lengths or positions touches no ids (``positions``), and a read of some documents
opens only row groups and pages whose range of ids can hold them (``documents_between``).

The place of a document in the whole sequence is its offset plus the ids of all files before its own:
sums over files (a row for each), prefixes of these in two levels.

Texts cross the network once, ids never.  Files are committed by Spark's writer, so a task that is lost
or run twice leaves nothing behind.

Cases: null and empty texts are the end id alone; null ids come first; rows with one id are ordered by
a hash of their texts and stay rows of their own (which of fully equal rows comes first doesn't show); an
empty table gives no rows; other columns are dropped; an id that holds most rows is spread over files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import before_buckets
from .vocab import byte_level, vocabulary
from .words import chunks, documents, ensure_checkpoint_dir, texts_of

END = 2
ROW_GROUP, PAGE = 32 << 20, 256 << 10
CHUNK = 4 << 20
MEMO = 400_000

LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part": "false",
    "parquet.enable.dictionary#offset": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


def encoded(docs: DataFrame, path: str, end: int = END, special: bool = True) -> DataFrame:
    """doc_id, part, offset, n_tokens, ids of every row of docs (doc_id, text), in its partitions and their order."""
    kind = docs.select("doc_id").schema[0]
    ids = T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)
    schema = T.StructType([kind, T.StructField("part", T.IntegerType(), False), T.StructField("offset", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, done = byte_level(path, special, MEMO), TaskContext.get().partitionId(), 0
        for rows in chunks(batches, "text", CHUNK):
            flat, before = encode(texts_of(rows.column("text")))
            n = len(before) - 1
            bounds = before + np.arange(n + 1)  # every document before has an end id of its own
            out = np.full(bounds[-1], end, np.int32)
            keep = np.ones(bounds[-1], bool)
            keep[bounds[1:] - 1] = False
            out[keep] = flat
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(done + bounds[:-1]), pa.array(np.diff(bounds)), lists], schema.names
            )
            done += int(bounds[-1])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, special: bool = True) -> None:
    """Writes the token files of docs (doc_id, text) to a new folder."""
    spark = docs.sparkSession
    # Rows of one id are told apart by their text, equal rows by where they lie, so that no id needs a file to itself.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_at"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_at")]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    encoded(dealt, path or vocabulary("byte_bpe_50k.json"), end, special).write.options(**LAYOUT).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of token files; what isn't used isn't read."""
    return spark.read.parquet(folder)


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens of every document, from the files' metadata columns alone."""
    rows = read(spark, folder).select("doc_id", "part", "offset", "n_tokens")
    return _placed(rows, rows)


def documents_between(spark: SparkSession, folder: str, low: int, high: int) -> DataFrame:
    """doc_id and ids of the documents with ids from low to high; other row groups and pages stay closed."""
    return read(spark, folder).where(F.col("doc_id").between(low, high)).select("doc_id", "ids")


def _placed(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """rows (part, offset, n_tokens, others) with start in place of part and offset; all_rows: those of all files."""
    files = all_rows.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("n"))
    starts = before_buckets(files, [], "part", ["n"]).select(F.col("part").alias("_part"), "n_before")
    placed = rows.join(starts, F.col("part") == F.col("_part"))
    rest = [c for c in rows.columns if c not in ("doc_id", "part", "offset", "n_tokens")]
    return placed.select("doc_id", (F.col("n_before") + F.col("offset")).cast("long").alias("start"), "n_tokens", *rest)


def checksums(rows: DataFrame) -> DataFrame:
    """rows (doc_id, part, offset, n_tokens, ids) with ids_crc32, the checksum of all ids as little-endian 32-bit numbers, in place of ids."""
    kept = [f for f in rows.schema if f.name in ("doc_id", "part", "offset", "n_tokens")]
    schema = T.StructType([*kept, T.StructField("ids_crc32", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column("ids")
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<i4")
            bounds = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([*[rows.column(f.name) for f in kept], pa.array(sums, pa.int64())], schema.names)

    return rows.select(*[f.name for f in kept], "ids").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), folder)
    return _placed(checksums(read(spark, folder)), read(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")
