import hashlib
from collections import Counter

import corpus_pipeline as cp
from driftloom.llm import mixing, toxicity

from .test_operators import brute_components, brute_dedup, check_packing, water, words


def sha(text):
    return hashlib.sha256(" ".join(words(text)).encode()).hexdigest()


def test_every_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = cp.drop_toxic(spark, docs, sf).cache()
    field = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r["doc_id"] for r in toxicity.score(docs, field).where("_score < 0.5").collect()}
    assert {r["doc_id"] for r in clean.collect()} == kept and clean.columns == list(cp.COLUMNS)

    one = cp.one_of_each_group(spark, clean, sf).cache()
    groups = brute_components([(r["doc_id"], r["text"]) for r in clean.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, c in groups.values()})

    cut = cp.drop_repeated_passages(spark, one, sf).cache()
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    want = brute_dedup(before.items(), 20)
    got = Counter((r["doc_id"], len(words(before[r["doc_id"]])), len(words(before[r["doc_id"]])) - len(words(r["text"])), sha(r["text"])) for r in cut.collect())
    assert got == want
    for r in cut.collect():
        assert r["n_chars"] == len(r["text"])
        if len(words(r["text"])) == len(words(before[r["doc_id"]])):  # nothing removed: not a byte changed
            assert r["text"] == before[r["doc_id"]]

    mixed = cp.mix_sources(spark, cut, sf).cache()
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(cut).collect()}) and max(copies.values()) <= 2
    size, source = {r["doc_id"]: len(words(r["text"])) for r in cut.collect()}, {r["doc_id"]: r["source"] for r in cut.collect()}
    sizes, taken = Counter(), Counter()
    for i, n in size.items():
        sizes[source[i]] += n
        taken[source[i]] += n * copies[i]
    for s, target in water(dict(sizes), 1.5, 2, (3, 1, 2)).items():
        assert abs(taken[s] - target) <= max(n for i, n in size.items() if source[i] == s) / 2
    packed = cp.pack_bins(spark, mixed, sf)
    check_packing(mixed.collect(), packed.collect(), 2048)


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs, sf_dir):
    for frame in (odd_docs, no_docs):
        for _, stage in cp.STAGES:
            frame = stage(spark, frame, sf_dir).cache()
        frame.count()


def test_second_stage_on_repeated_and_null_ids(spark):
    """An id with different texts is a document for each of them; no unrelated text is lost."""
    text = lambda tag, n=40, off=0: " ".join(f"{tag}{i + off}" for i in range(n))
    rows = [
        (1, text("a"), "en", "x", 1),
        (1, text("b"), "en", "x", 1),  # the same id, unrelated
        (1, text("b"), "de", "y", 2),  # repeats the row above
        (0, text("a"), "en", "x", 1),  # copy of the first text of 1
        (5, text("b") + " tail", "en", "x", 1),  # near copy of the second text of 1
        (6, text("c"), "en", "x", 1),
        (None, text("c"), "en", "x", 1),
        (None, text("d"), "en", "x", 1),
        (None, text("d"), "en", "z", 1),
        (None, text("e"), None, None, None),
        (None, None, None, None, None),
        (7, None, "en", "x", 0),
        (8, "", "en", "x", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"], r["lang"]) for r in cp.one_of_each_group(spark, docs, "").collect())
    want = [(0, text("a"), "en"), (1, text("b"), "de"), (6, text("c"), "en"), (None, text("d"), "en"), (None, text("e"), None), (None, None, None), (7, None, "en"), (8, "", "en")]
    assert got == Counter(want)
    plain = docs.where("doc_id >= 5")
    assert {r["doc_id"] for r in cp.one_of_each_group(spark, plain, "").collect()} == {5, 6, 7, 8}
    assert cp.one_of_each_group(spark, docs.limit(0), "").count() == 0


def test_third_stage_keeps_what_it_does_not_remove(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"  head\n\n{passage}\tend\n"), (2, f"other\n{passage}\n\nlast  line "), (3, "a  b\nc\r\n"), (4, passage), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.drop_repeated_passages(spark, docs, "").collect()}
    assert out == {1: (rows[0][1], len(rows[0][1])), 2: ("other\nlast  line ", 17), 3: (rows[2][1], 8), 4: ("", 0), 5: (None, 0), 6: ("", 0)}
