"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of ``cells`` cells; a row's key hashes
to a cell, whose owner is the next point clockwise.  A shard holds its load bound
and no more; rows that meet a full shard continue clockwise to the next point of a
shard with room.  The bounds are the tight ones (they sum to the number of rows and
differ by one at most), so shard counts are at most one apart: the law ``rows``.

Only counts by ring cell, at most ``cells`` numbers, reach the driver.  The walk over
them yields, for each cell, which ranks of its rows go to which shard and from which
slot on; one shuffle of narrow rows by cell ranks the rows, and a broadcast of the
plan (at most ``cells`` + points + shards rows) places them.  The narrow rows are written
once, so texts are read once.

A row's key is its id, the text's checksum and size, and a running number among rows equal in
these, in sixteens: copies of one id and equal rows spread over the ring, and which shards
a group of equal rows takes doesn't depend on how the table is partitioned.

Cases: null ids are a value like others; null and empty texts have size 8 and the checksum 0; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import documents, running_number

CELLS = 1 << 14


def ring_owners(n_shards: int, vnodes: int, cells: int = CELLS) -> list[int]:
    """Owner of each cell: the shard of the first point at or after it, clockwise."""
    points: dict[int, int] = {}
    for shard in range(n_shards):
        for replica in range(vnodes):
            digest = hashlib.md5(f"shard-{shard}/{replica}".encode()).digest()
            points.setdefault(int.from_bytes(digest[:8], "big") % cells, shard)
    at = sorted(points)
    return [points[at[bisect.bisect_left(at, c) % len(at)]] for c in range(cells)]


def bounded_walk(counts: dict[int, int], owners: list[int], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) for all rows, given the rows of each cell."""
    total, cells = sum(counts.values()), len(owners)
    bound = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used, plan, over = [0] * n_shards, [], []
    for cell in sorted(counts):
        shard = owners[cell]
        take = min(counts[cell], bound[shard] - used[shard])
        if take:
            plan.append((cell, 0, take, shard, used[shard]))
            used[shard] += take
        if take < counts[cell]:
            over.append((cell, take))
    turns = [c for c in range(cells) if owners[c] != owners[c - 1]]  # where the owner changes
    for cell, done in over:
        k = bisect.bisect_right(turns, cell)
        while done < counts[cell]:
            shard = owners[turns[k % len(turns)]] if turns else owners[0]
            take = min(counts[cell] - done, bound[shard] - used[shard])
            if take:
                plan.append((cell, done, done + take, shard, used[shard]))
                used[shard] += take
                done += take
            else:  # the next point of a shard with room
                k += 1
                continue
            k += 1
    return plan


def assign_shards(docs: DataFrame, n_shards: int = 24, vnodes: int = 64, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text)."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    keys = ["doc_id", "text_crc32", "size"]
    rows = running_number(rows, keys, "_turn")
    rows = rows.withColumn("_pos", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size", F.shiftright("_turn", 4)))
    rows = rows.withColumn("_cell", F.pmod(F.shiftrightunsigned("_pos", 20), F.lit(cells)).cast("int"))
    counts = {r["_cell"]: r["n"] for r in rows.groupBy("_cell").agg(F.count("*").alias("n")).collect()}  # at most `cells` rows
    plan = bounded_walk(counts, ring_owners(n_shards, vnodes, cells), n_shards)
    kind = "array<struct<p_cell:int,p_from:long,p_to:long,p_shard:int,p_slot:long>>"
    names = ("p_cell", "p_from", "p_to", "p_shard", "p_slot")
    text = json.dumps([dict(zip(names, p)) for p in plan])
    placed = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), kind)))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_pos", *keys, "_turn")) - 1)
    near = (F.col("_cell") == F.col("p_cell")) & (F.col("_rank") >= F.col("p_from")) & (F.col("_rank") < F.col("p_to"))
    return ranked.join(F.broadcast(placed), near).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("p_shard").alias("shard"),
        (F.col("p_slot") + F.col("_rank") - F.col("p_from")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir))
