"""Alignment of two tokenizers against plain code, wide groups, pairs beyond the broadcast, odd rows."""

import hashlib
import time
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from driftloom.llm import alignment
from driftloom.llm.vocab import byte_tokens, piece_tokens, vocabulary

from .test_tokens import TEXTS


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    return lambda x: a.encode(" " + x, add_special_tokens=False).ids, lambda x: b.encode(x)


def plain(rows, sides):
    """The contract, text by text."""
    parts = byte_tokens(vocabulary("byte_bpe_50k.json")), piece_tokens(vocabulary("piece_bpe_32k.model"))
    texts = []
    for _, text in rows:
        ids = [f(text) if text else [] for f in sides]
        if text and any(b"".join(p[i] for i in x) != b" " + text.encode() for p, x in zip(parts, ids)):
            ids = [[], []]
        ends = []
        for p, x in zip(parts, ids):
            at, out = 0, []
            for i in x:
                at += len(p[i])
                out.append(at)
            ends.append(out)
        groups, a, b = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            a2, b2 = ends[0].index(e, a) + 1, ends[1].index(e, b) + 1
            groups.append((ids[0][a:a2], ids[1][b:b2]))
            a, b = a2, b2
        links = Counter()
        for x, y in groups:
            for i, n in Counter(x).items():
                for j, m in Counter(y).items():
                    links[i, j] += n * m
        texts.append((ids, groups, links))
    count = Counter(p for _, _, links in texts for p in links)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (doc_id, _), (ids, groups, links) in zip(rows, texts):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if count[p] == most[p[0]])
        out.append((doc_id, len(ids[0]), len(ids[1]), len(groups), sum(links.values()), best, sum(n * count[p] for p, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if ids[0] else ""))
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_query_against_plain_code(spark, sf_dir, docs, sides):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(alignment.query(spark, sf_dir)) == sorted(plain(rows, sides), key=str)


@pytest.mark.parametrize("frequent", [1 << 20, 40])
def test_special_texts_and_rare_pairs_by_shuffle(spark, sides, frequent):
    rows = [(i, x) for i, x in enumerate([*TEXTS, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.align(df, frequent=frequent)) == sorted(plain(rows, sides), key=str)


@pytest.mark.parametrize("wide", [1, 3, 10])
def test_wide_groups(spark, docs, sides, monkeypatch, wide):
    monkeypatch.setattr(alignment, "WIDE", wide)
    rows = [(r.doc_id, r.text[:3000] if r.text else None) for r in docs.select("doc_id", "text").limit(40).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(alignment.align(df)) == sorted(plain(rows, sides), key=str)


def test_odd_rows(spark, odd_docs, no_docs, sides):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert rows_of(alignment.align(odd_docs)) == sorted(plain(rows, sides), key=str)
    assert alignment.align(no_docs).count() == 0
    huge = spark.createDataFrame([(1, "A" * 50_000), (2, "ab" * 30_000 + " c"), (3, " " * 20_000)], "doc_id long, text string")
    assert rows_of(alignment.align(huge)) == sorted(plain([(r.doc_id, r.text) for r in huge.collect()], sides), key=str)


def test_time_follows_length(spark):
    """What lambdas read is made once for a text, whichever columns are used."""
    rows = spark.createDataFrame([(1, " ".join(f"word{i} x" for i in range(30_000)))], "doc_id long, text string")
    made = alignment.grouped(alignment.tokens(rows, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")))
    for column in ("n_links", "n_groups", "groups", "_links"):
        began = time.perf_counter()
        made.select(column).collect()
        assert time.perf_counter() - began < 20


def test_known_pieces_are_aligned_once(spark):
    """Texts get what their frequent pieces gave by number; only the other pieces' tokens are aligned where they lie."""
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    texts = ["the cat, the dog", "unlikeliest the", " the  dog the ", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = spark.createDataFrame([(x, x) for x in ("cat,", "dog", "the")], "doc_id string, text string")
    known = alignment.grouped(alignment.tokens(pieces, *paths)).cache()
    sizes = {r.doc_id: (r.n_a, r.n_b) for r in known.collect()}
    names = sorted(sizes)
    held = spark.sparkContext.broadcast(([b" " + x.encode() for x in names], *(np.array([sizes[x][k] for x in names]) for k in (0, 1))))
    rows = {r.doc_id: r for r in alignment.parts(docs, held, *paths).collect()}
    assert rows[0].pieces == [2, 0, 2, 1] and not rows[0].a_ids and not rows[0].p_ends
    assert rows[1].pieces == [-1, 2] and rows[1].p_ends == [12] == rows[1].a_ends[-1:] == rows[1].b_ends[-1:]
    assert rows[2].pieces == [-1, -2] and rows[2].p_ends == [10, 15]
    assert all(rows[k].pieces == [] and rows[k].n_a == 0 for k in (3, 4))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "_links"]
    by_row = lambda df: sorted(map(tuple, df.select(columns).collect()))
    whole = alignment.grouped(alignment.tokens(docs, *paths)).collect()
    want = sorted((*(r[c] for c in columns[:-1]), sorted(r["_links"])) for r in whole)
    assert by_row(alignment.aligned(docs, known, *paths)) == by_row(alignment.aligned(docs, known.limit(0), *paths)) == want


def test_tasks_hold_little():
    """What a task holds of the known pieces and remembers of the others stays small, however many there are."""
    kind = T.StructType([T.StructField("doc_id", T.LongType())])
    docs = SimpleNamespace(select=lambda *_: SimpleNamespace(schema=kind, mapInArrow=lambda run, _: run))
    names, ones = [b" k%x" % k for k in range(200_000)], np.ones(200_000, np.int32)
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    texts = [" ".join([f"k{k:x}", *(f"u{k + i:x}" for i in range(5000))]) for k in range(0, 150_000, 5000)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x])], ["doc_id", "text"]) for k, x in enumerate(texts)]
    run = alignment.parts(docs, SimpleNamespace(value=(names, ones, ones)), *paths)
    assert sum(x.num_rows for x in run(iter(batches[:1]))) == 1  # the vocabularies are loaded
    tracemalloc.start()
    try:
        found = [x.column("pieces")[0].as_py()[0] for x in run(iter(batches))]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == list(range(0, 150_000, 5000))
    assert most < 32 << 20


@pytest.mark.parametrize("alike", [hash, len])
def test_places(monkeypatch, alike):
    """Texts with one hash are never taken for each other."""
    monkeypatch.setattr(alignment, "hash", alike, raising=False)
    listed = [b" a", b" bb", b" cc", b" ddd"]
    places, texts = alignment.Places(pa.array(listed, pa.large_binary())), [b" a", b" x", b" cc", b" bb", b"", b" ddd", b" long"]
    found = places.of(texts).tolist()
    assert [found[k] for k in (0, 1, 4, 5, 6)] == [0, -1, -1, 3, -1] and sorted(found[2:4]) in ([1, 2], [-1, 1], [-1, 2])
    assert all(p < 0 or listed[p] == x for p, x in zip(found, texts))
    assert places.of([]).tolist() == [] and alignment.Places(pa.array([], pa.large_binary())).of([b" a"]).tolist() == [-1]
