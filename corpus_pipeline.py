"""A corpus pipeline of five stages; each takes and returns documents (doc_id, text, lang, source, n_chars).

1.  toxicity: documents that the field scores 1/2 or more go.
2.  n-gram Jaccard join: of each group of near-duplicates (five-word shingles, similarity 0.8 or
    more) the document with the smallest id stays, once.
3.  substring dedup: words in windows of 20 that start earlier elsewhere go, each with the white space
    after it; documents stay, with what is left of their text, and texts that lose nothing stay as they are.
4.  mixing: sources are mixed to their targets; a document comes as often as the mix takes it.
5.  packing: the result's rows are pieces of documents with their bins.

The model of the first stage is learned from ``labels``; no later stage reads other tables.
Stages are joined by tables: each result is written as Parquet in the checkpoint folder and read
again.  SQL expresses neither the first stage nor the last, so ORACLE_SQL is None and the tests
compare with brute force.

Cases: null texts count as empty in every stage and pass the first three unchanged (their n_chars
is 0 after the third); an id that repeats with different texts, or a null id, is a document for
each different text in the second stage, and rows equal in id and text are one there (the first by
their other columns); ties go to the smaller id; texts of any length are taken whole; an empty
table passes all stages; other columns of the input are dropped by the first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import jaccard_join, mixing, packing, substring_dedup, toxicity
from driftloom.llm.words import documents, ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), field).where(F.col("_score") < 0.5).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.representatives(docs.select(*COLUMNS), width=5, num=80, den=100)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup(docs.select(*COLUMNS), joined=False)
    size = F.coalesce(F.length("_kept"), F.lit(0)).cast("long")
    return done.select("doc_id", F.col("_kept").alias("text"), "lang", "source", size.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*COLUMNS)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_bins),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of sf_dir."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
