"""Connected components of a table of links, by alternating large-star and small-star steps.

Each round replaces links by links to smaller ids and keeps the components; the table never
grows beyond twice its size, and a hub's links are met by partial minimums before any shuffle.
Rounds go on until the table no longer changes, however many that takes (about log2 of the
longest path); each is checkpointed.

Cases: links of a node with itself and repeated links count for nothing; a link with a null end is
no link; an empty table gives no rows; nodes without a link to another are not in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import checkpointed


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """links: (u, v) longs.  (node, component) for every node with a link to another; component is the smallest node."""
    edges = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = checkpointed(edges)
    before = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(low, F.col("u") == F.col("w"))
        small = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
        edges = checkpointed(small.distinct())
        after = _state(edges)
        if after == before:  # counts and sums of 64-bit hashes of all links
            break
        before = after
    out = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = out.select(F.col("component").alias("node"), "component").distinct()
    return out.union(roots)
