"""The bounded sample: over-long rows, copies and rare classes."""

import pytest

from driftloom.llm import langid, toxicity
from driftloom.llm.training import beginning, bounded_sample, equal_share
from pyspark.sql import functions as F


def table(spark, rows):
    """(id, text, label) rows in the order of their id hashes."""
    ids = [r[0] for r in spark.range(len(rows)).orderBy(F.xxhash64("id")).collect()]
    return spark.createDataFrame([(i, *r) for i, r in zip(ids, rows)], "doc_id long, text string, y int")


def sample(df, max_rows, max_bytes):
    return bounded_sample(df.select("doc_id", "text"), df.select("doc_id", "y"), "y", max_rows, max_bytes)


def test_a_long_text_takes_no_other_row_away(spark):
    df = table(spark, [("long " * 1000, 0)] + [(f"row {i}", i % 2) for i in range(20)])
    got = sample(df, 100, 1000)
    assert len(got) == 21 and sum(len(t) for t, _ in got) <= 1000
    assert {t for t, _ in got} >= {f"row {i}".encode() for i in range(20)}


def test_copies_count_once(spark):
    df = table(spark, [("copy " * 40, 1) if i % 3 == 0 else (f"row {i}", 0) for i in range(30)])
    got = sample(df, 100, 400)
    assert [t for t, _ in got].count(("copy " * 40).encode()) == 1 and len(got) == 21


def test_a_rare_class_stays_or_is_reported(spark):
    df = table(spark, [(f"row {i}", 0) for i in range(50)] + [("rare", 1), (None, 2)])
    got = sample(df, 10, 1000)
    assert len(got) == 10 and (b"rare", 1) in got
    with pytest.raises(ValueError, match="every class"):
        sample(df, 1, 1000)
    with pytest.raises(ValueError, match="no room"):
        sample(df, 10, 3)


def test_models_survive_a_long_text(spark):
    df = table(spark, [("the cat and the dog " * 5000, 0)] + [(f"darn words here {i}" if i % 2 else f"fine words there {i}", i % 2) for i in range(200)])
    assert toxicity.train(df.select("doc_id", "text"), df.select("doc_id", F.col("y").alias("toxic")), max_bytes=20000) is not None
    docs = df.select("doc_id", "text", F.when(F.col("y") == 1, "en").otherwise("de").alias("lang"))
    assert langid.train(docs, max_bytes=20000) is not None


def test_shares():
    assert equal_share([5, 1, 9], 100) == 9 and equal_share([5, 1, 9], 11) == 5 and equal_share([8, 8], 6) == 3 and equal_share([], 4) == 0
    assert beginning("ab ünï".encode(), 5) == b"ab" and beginning("üü".encode(), 3) == "ü".encode() and beginning(b"abc", 3) == b"abc"
