"""Streams (t, features, label) over the tables of a data folder; arrival numbers are dense and taken in buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ranked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in order of their id, which is the arrival number."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("t"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numeric features of line items in key order, labelled by return flag."""
    li = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = ranked(li, [], F.floor(F.col("l_orderkey") / 1024), keys)
    values = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return li.select("t", values.alias("features"), label.alias("label"))


def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces of ten runs: seed, t from 1 in order of time, a rank from the value, and the event's type."""
    e = table(spark, sf_dir, "events")
    e = e.select((F.col("user_id") % 10).cast("int").alias("seed"), "ts", "event_id", "event_type", "value")
    rank = (4 + F.floor(F.abs(F.col("value"))) % 5).cast("int")
    e = ranked(e, ["seed"], 24 * F.datediff("ts", F.lit("1970-01-01")) + F.hour("ts"), ["ts", "event_id"])
    return e.withColumn("t", F.col("t") + 1).select("seed", "t", rank.alias("rank"), "event_type", "value", "event_id")
