"""Bounded samples of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RARE = 8  # rows added for a class that the lowest hashes miss


def equal_share(sizes: list[int], total: int) -> int:
    """The largest number of bytes that every text may have at most, so that all texts together have `total` at most."""
    left = total
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return left // (len(sizes) - k)
        left -= n
    return max(sizes, default=0)


def beginning(text: bytes, size: int) -> bytes:
    """At most `size` bytes of a text, cut between words if it has a space there, never inside a character."""
    if len(text) <= size:
        return text
    head = text[:size].decode(errors="ignore").encode()
    at = max(head.rfind(b" "), head.rfind(b"\n"))
    return head[:at] if at > 0 else head


def bounded_sample(docs: DataFrame, ids: DataFrame, label: str, max_rows: int, max_bytes: int) -> list[tuple[bytes, object]]:
    """(text bytes, label) of at most max_rows rows of docs, max_bytes of text in all.

    ids: (doc_id, <label>), a row for each document that may be learned from.  The rows with
    the lowest id hashes are taken, so the sample is the same in every run and grows no
    further with the tables; sizes and digests are read first, texts for the chosen rows only.

    Equal texts with one label count once.  Where the texts pass max_bytes, all rows stay and
    the longest give their beginnings: no text has more than an equal share of what shorter
    ones leave.  A class that the lowest hashes miss comes in by RARE rows of its own, in place
    of the last rows; if rows with a text exist whose class has no room, ValueError is raised.
    """
    order: list[Column] = [F.xxhash64("doc_id"), F.col("doc_id")]
    about = [F.xxhash64("doc_id").alias("_hash"), F.octet_length("text").alias("_size"), F.md5("text").alias("_digest"), F.crc32("text").alias("_crc")]
    known = ids.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    picked = texts.join(F.broadcast(known.orderBy(*order).limit(max_rows)), "doc_id").select("doc_id", "_label", *about)
    rows = picked.orderBy("_hash", "doc_id", "_crc").limit(max_rows).collect()  # short ones
    have = {r["_label"] for r in rows}
    others = known.where(~F.col("_label").isin(list(have))) if have else known
    if others.limit(1).count():
        place = F.row_number().over(Window.partitionBy("_label").orderBy("_hash", "doc_id", "_crc"))
        extra = texts.select("doc_id", *about).join(others, "doc_id").withColumn("_place", place).where(F.col("_place") <= RARE)
        added = extra.orderBy("_place", "_hash", "doc_id", "_crc").limit(max_rows + 1).drop("_place").select("doc_id", "_label", "_hash", "_size", "_digest", "_crc").collect()
        first = {r["_label"]: r for r in reversed(rows)}  # a row of each class found before
        room = max_rows - len(first)
        if len({r["_label"] for r in added}) > room:
            raise ValueError(f"a sample of {max_rows} rows has no room for every class of {label}")
        added = added[:room]
        rest = [r for r in rows if first[r["_label"]] is not r]
        rows = [*first.values(), *added, *rest[: room - len(added)]]
        rows.sort(key=lambda r: (r["_hash"], r["doc_id"], r["_crc"]))
    once: dict[tuple, object] = {}
    for r in rows:
        once.setdefault((r["_digest"], r["_label"]), r)
    if not once:
        return []
    share = equal_share([r["_size"] for r in once.values()], max_bytes)
    if not share and any(r["_size"] for r in once.values()):
        raise ValueError(f"{max_bytes} bytes have no room for a sample of {len(once)} texts")
    schema = T.StructType([T.StructField("_id", docs.schema["doc_id"].dataType), T.StructField("_d", T.StringType()), T.StructField("_label", known.schema["_label"].dataType)])
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"], *k) for k, r in once.items()], schema)
    found = texts.join(F.broadcast(wanted), F.col("doc_id") == F.col("_id")).where(F.md5("text") == F.col("_d"))
    found = found.select("_d", "_label", F.substring(F.col("text").cast("binary"), 1, share + 1).alias("_text")).dropDuplicates(["_d", "_label"])
    text = {(r["_d"], r["_label"]): bytes(r["_text"]) for r in found.collect()}  # max_bytes, and a byte for each row
    return [(beginning(text[k], share), k[1]) for k in once]
