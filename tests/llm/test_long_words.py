"""Texts of one very long word: every operator gives a result, in a time that follows the length."""

import time

import pytest

from driftloom.llm import alignment, jaccard_join, langid, mixing, packing, periodic, quality_classifier, quality_rules, sharding, substring_dedup, token_files, toxicity

WORDS = ["A" * 50_000 + "b", "A" * 50_000, "b" * 50_000, "#" * 50_000, "0" * 50_000, "Ab" * 25_000, "é" * 50_000, "漢" * 50_000, "\U0001f600" * 20_000, "A1#b" * 12_500]


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(i, w, "en", "a", len(w)) for i, w in enumerate(WORDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def long_labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(WORDS))], "doc_id long, quality int, toxic int")


RUNS = {
    "packing": lambda d, labels, tmp: packing.pack(d),
    "mixing": lambda d, labels, tmp: mixing.mix(d),
    "toxicity": lambda d, labels, tmp: toxicity.score(d, toxicity.train(d, labels)),
    "substring_dedup": lambda d, labels, tmp: substring_dedup.dedup(d),
    "quality_rules": lambda d, labels, tmp: quality_rules.judge(d),
    "quality_classifier": lambda d, labels, tmp: quality_classifier.score(d, quality_classifier.train(d, labels)),
    "langid": lambda d, labels, tmp: langid.predict(d, langid.train(d)),
    "jaccard_join": lambda d, labels, tmp: jaccard_join.representatives(d, width=5, num=80, den=100),
    "sharding": lambda d, labels, tmp: sharding.assign_shards(d),
    "periodic": lambda d, labels, tmp: periodic.runs(d),
    "alignment": lambda d, labels, tmp: alignment.align(d),
    "token_files": lambda d, labels, tmp: (token_files.write(d, f"{tmp}/f"), token_files.positions(d.sparkSession, f"{tmp}/f"))[1],
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_one_long_word(long_docs, long_labels, tmp_path, name):
    began = time.perf_counter()
    found = RUNS[name](long_docs, long_labels, tmp_path).collect()
    assert len(found) >= 1 and time.perf_counter() - began < 60


def test_shouted_words_are_counted_as_before(spark):
    rows = [(1, "AB Ab A aB É ÉÀ A1B2 a1 A-B -- 1A2 ABc")]
    got = quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert got.n_shouted == 4
