"""Periodic runs against a search of all starts and periods; the contract's columns against plain code; odd rows."""

import hashlib
import zlib

import numpy as np
import pytest

from driftloom.llm import periodic


def brute_runs(words, least=12):
    """All maximal stretches with a period, the smallest one."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                out.setdefault((i, length), q)
            i = j + 1
    return sorted((i, length, q) for (i, length), q in out.items())


def fibonacci(n):
    a, b = "b", "a"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


@pytest.mark.parametrize("seed", range(40))
def test_random_sequences(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(12):
        n, letters = int(rng.integers(0, 90)), int(rng.integers(1, 4))
        x = rng.integers(0, letters, n)
        if n > 20 and rng.random() < 0.5:
            a, p = int(rng.integers(0, n // 2)), int(rng.integers(1, 12))
            x[a:] = x[a + (np.arange(n - a) % p) % (n - a)]
        texts.append(x.tolist())
    ends = np.cumsum([len(x) for x in texts])
    codes = np.array([w for x in texts for w in x], np.int64)
    got = [tuple(r) for r in periodic.text_runs(codes, ends).tolist()]
    want = [(s + e - len(x), length, q) for x, e in zip(texts, ends.tolist()) for s, length, q in brute_runs(x)]
    assert got == sorted(want)


@pytest.mark.parametrize("words", [list("a" * 300), list("ab" * 150), fibonacci(400), list("aab" * 40 + "x" + "aab" * 40), list(("a" * 20 + "b") * 9)])
def test_known_sequences(words):
    index = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.array([index[w] for w in words], np.int64)
    got = [tuple(r) for r in periodic.text_runs(codes, np.array([len(words)])).tolist()]
    assert got == brute_runs(words)


def test_parts_do_not_matter(monkeypatch):
    monkeypatch.setattr(periodic, "PART", 16)
    test_random_sequences(3)
    test_known_sequences(fibonacci(300))


def plain(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words) if n < 3000 else [tuple(r) for r in periodic.text_runs(np.unique(words, return_inverse=True)[1], np.array([n])).tolist()]
    dropped = set()
    for s, length, q in found:
        dropped.update(range(s + q, s + length))
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found).encode()
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *row, sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query(spark, sf_dir, docs):
    got = sorted(tuple(r) for r in periodic.query(spark, sf_dir).collect())
    rows = docs.select("doc_id", "text").collect()
    assert got == sorted((plain(r.doc_id, r.text) for r in rows), key=lambda x: x[0])
    assert sum(r[1] > 0 for r in got) >= len(rows) // 20


def test_odd_rows(spark, odd_docs, no_docs):
    extra = [(30, "x " * 5000, "en", "a", 1, 1, ""), (31, "W" * 50_000 + " w", None, None, 1, 1, ""), (32, ("a b c " * 5000 + "d ") * 2, "en", "a", 1, 1, "")]
    rows = odd_docs.union(spark.createDataFrame(extra, odd_docs.schema)).withColumnRenamed("shard", "_runs")
    got = periodic.runs(rows)
    assert got.columns == [*rows.columns, "__runs", "_collapsed"]
    out = {r.doc_id: r for r in got.where("doc_id >= 30").collect()}
    assert out[30]["__runs"] == [(0, 5000, 1)] and out[30]["_collapsed"] == "x"
    assert out[31]["__runs"] == [] and out[31]["_collapsed"] == "W" * 50_000 + " w"
    assert out[32]["__runs"] == [(0, 15000, 3), (0, 30002, 15001), (15001, 15000, 3)]
    assert got.count() == rows.count() and periodic.runs(no_docs).count() == 0
