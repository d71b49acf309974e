import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftloom.llm import components, jaccard_join, langid, mixing, packing, quality_classifier, quality_rules, sharding, substring_dedup, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# packing


def check_packing(rows, out, capacity):
    got, bins = Counter(), defaultdict(list)
    for r in out:
        got[r["doc_id"]] += r["n_words"]
        bins[r["bin_id"]].append(r)
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += len(words(r["text"]))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert len({(r["bin_id"], r["position"]) for r in out}) == len(out)
    for held in bins.values():
        assert sum(r["n_words"] for r in held) <= capacity
        for name in ("source", "cluster"):
            some = [r[name] for r in held if r[name] is not None]
            assert len(some) == len(set(some))


def test_packing_does_not_depend_on_partitions(docs, odd_docs):
    for frame in (docs, odd_docs, odd_docs.union(odd_docs)):
        one, two = (Counter(map(str, packing.pack(f, 512, 50).collect())) for f in (frame, frame.repartition(7, "n_chars").sortWithinPartitions("text")))
        assert one == two


def test_packing_holds_everything_without_conflicts(odd_docs, no_docs, docs):
    for frame, capacity in ((odd_docs, 64), (docs, 512)):
        check_packing(frame.select("doc_id", "text").collect(), packing.pack(frame, capacity, 50).collect(), capacity)
    assert packing.pack(no_docs).count() == 0


def test_best_fit_is_the_tightest_compatible_bin():
    rng, capacity = random.Random(3), 100
    sizes = sorted((rng.randint(0, 100) for _ in range(300)), reverse=True)
    sources, clusters = [rng.randint(-1, 5) for _ in sizes], [rng.randint(-1, 70) for _ in sizes]
    got = packing.pack_block(np.array(sizes), np.array(sources), np.array(clusters), capacity)
    bins = []
    for size, s, c, at in zip(sizes, sources, clusters, got):
        fits = [b["room"] for b in bins if b["room"] >= size and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])]
        if at == len(bins):
            assert not fits
            bins.append({"room": capacity, "s": set(), "c": set()})
        else:
            assert bins[at]["room"] == min(fits)
        bins[at]["room"] -= size
        bins[at]["s"].add(s)
        bins[at]["c"].add(c)


# mixing


def water(sizes, share, cap, weights):
    named = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(named)}
    total, target = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in named if s not in target]
        left = total - sum(target.values())
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > cap * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in open_}
        target |= {s: float(cap * sizes[s]) for s in over}


def test_mixing_targets_and_takes(spark, odd_docs, no_docs, docs):
    for frame in (odd_docs, docs):
        out = mixing.mix(frame).collect()
        assert len(out) == frame.count()
        sizes, taken = Counter(), Counter()
        for r in out:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        target = water(dict(sizes), 1.5, 2, (3, 1, 2))
        for r in out:
            assert r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(target[r["source"]])
        assert sorted(map(str, out)) == sorted(map(str, mixing.mix(frame).collect()))
    largest = {s: max(r["size"] for r in out if r["source"] == s) for s in sizes}
    for s in sizes:  # whole documents: within half of the largest one
        assert abs(taken[s] - target[s]) <= largest[s] / 2
    assert mixing.mix(no_docs).count() == 0


def test_inclusion_frequencies_are_the_expected_copies(spark):
    """Sixty sources of the same 200 sizes: how often a size is taken is what its measure expects."""
    rng = random.Random(5)
    sizes = [rng.choice([1, 2, 3, 6, 12, 30, 60, 120]) for _ in range(200)]
    rows = [(1000 * s + i, " ".join(["w"] * n), f"s{s:03d}") for s in range(60) for i, n in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(frame, total_share=0.8, weights=(1,)).collect()
    # The expected copies by bisection: min(2, c * digits) whose words are 0.8 of all words.
    low, high = 0.0, 9.0
    for _ in range(99):
        c = (low + high) / 2
        low, high = (c, high) if sum(n * min(2, c * n.bit_length()) for n in sizes) < 0.8 * sum(sizes) else (low, c)
    copies = defaultdict(list)
    for r in out:
        copies[r["size"]].append(r["copies"])
    for n, got in copies.items():
        e = min(2, c * n.bit_length())
        assert set(got) <= {int(e), int(e) + 1, min(2, int(e) + 2)}
        assert abs(sum(got) / len(got) - e) < 0.05
    assert sum(copies[120]) / len(copies[120]) > 2 * sum(copies[2]) / len(copies[2])


def test_mixing_splits_a_large_group_of_equal_rows(spark):
    rows = [(7, "five words are in here", "a")] * 1000 + [(8 + i, "w " * (i % 9 + 1), "a") for i in range(100)] + [(None, "x y", None)] * 300
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for share in (0.3, 0.9, 1.5):
        out = mixing.mix(frame, total_share=share).collect()
        assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len(words(t))) for i, t, _ in rows)
        for source, largest in (("a", 9), (None, 2)):
            of = [r for r in out if r["source"] == source]
            assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= largest / 2
        wide = mixing.mix(frame, total_share=share, keep=("text",)).collect()
        assert Counter((r["doc_id"], r["copies"]) for r in wide) == Counter((r["doc_id"], r["copies"]) for r in out)


def test_mixing_keeps_columns_and_agrees_with_the_narrow_form(docs):
    narrow = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    wide = mixing.mix(docs, keep=("text", "lang")).collect()
    assert {r["doc_id"]: r["copies"] for r in wide} == narrow and wide[0]["lang"] is not None


# toxicity and quality


def accuracy(out, labels, column):
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    return sum(a == b for a, b in held) / len(held)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = toxicity.query(spark, sf).collect()
    assert accuracy(out, spark.read.parquet(f"{sf}/labels.parquet"), "toxic") > 0.93
    assert all(0 <= r["score"] <= 1 for r in out)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    spans = [texts[r["doc_id"]][s["start"] : s["end"]] for r in out for s in r["spans"]]
    assert spans and all(s == s.strip() for s in spans)


def enumerated(e, move):
    """(log of the sum over all state sequences, marginals, expected pairs) of one chain."""
    n = len(e)
    total, on, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        p = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1)))
        total, on = total + p, on + p * np.array(y)
        for i in range(n - 1):
            pairs[y[i], y[i + 1]] += p
    return np.log(total), on / total, pairs / total


def test_messages_against_enumeration():
    move, rng = np.array([[0.0, -1.0], [-0.5, 1.5]]), np.random.default_rng(3)
    sizes = [5, 1, 9, 2, 12, 4]
    e, doc = rng.normal(0, 2, sum(sizes)), np.repeat([0, 2, 3, 5, 6, 9], sizes)
    want = [enumerated(x, move) for x in np.split(e, np.cumsum(sizes)[:-1])]
    for piece in (1, 2, 4, 64):  # chains are whole, however they are cut into pieces
        got = toxicity.Messages(e, doc, move, piece)
        assert np.allclose(got.marginals(), np.concatenate([w[1] for w in want]))
        assert np.allclose(got.pairs(), sum(w[2] for w in want))
    assert not len(toxicity.Messages(e[:0], doc[:0], move).marginals())
    long = toxicity.Messages(np.tile(e, 500), np.zeros(500 * len(e), int), move, 7).marginals()
    assert np.allclose(long, toxicity.Messages(np.tile(e, 500), np.zeros(500 * len(e), int), move, 100_000).marginals(), rtol=1e-9)


def test_gradient_of_the_field_against_finite_differences():
    rng, field = np.random.default_rng(8), toxicity.Field(4)
    field.own, field.before, field.after = (rng.normal(0, 0.5, 16) for _ in range(3))
    field.bias, field.move = -0.3, np.array([[0.0, -0.6], [0.4, 0.9]])
    slot = rng.integers(0, 16, (6, 5))
    doc = np.repeat([0, 1, 2], [7, 1, 5])
    word, gold = rng.integers(0, 6, len(doc)), rng.integers(0, 2, len(doc)).astype(float)

    def likelihood():
        e, out = toxicity.emissions(toxicity.scores_of(field, slot), field.bias, word, doc), 0.0
        for d in range(3):
            at = np.flatnonzero(doc == d)
            y = gold[at].astype(int)
            out += e[at] @ y + sum(field.move[a, b] for a, b in zip(y, y[1:])) - enumerated(e[at], field.move)[0]
        return out

    assert toxicity.blocks(doc, 8) == [(0, 8), (8, 13)] and toxicity.blocks(doc, 3) == [(0, 7), (7, 8), (8, 13)] and toxicity.blocks(doc[:0]) == []
    got = toxicity.gradient(field, word, doc, slot, gold)
    for name in ("own", "before", "after", "move"):
        values = getattr(field, name)
        for i in np.ndindex(values.shape):
            was, sides = values[i], []
            for step in (1e-5, -1e-5):
                values[i] = was + step
                sides.append(likelihood())
            values[i] = was
            assert got[name][i] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-5)
    was, sides = field.bias, []
    for step in (1e-3, -1e-3):
        field.bias = was + step
        sides.append(likelihood())
    assert got["bias"] == pytest.approx((sides[0] - sides[1]) / 2e-3, abs=1e-3)


def test_trained_operators_on_odd_rows(spark, odd_docs, no_docs, docs, labels):
    field, model, lang = toxicity.train(docs, labels), quality_classifier.train(docs, labels), langid.train(docs)
    for frame in (odd_docs, no_docs):
        n = frame.count()
        for f in (field, None):
            assert all(0 <= r["_score"] <= 1 for r in toxicity.score(frame, f).collect())
        for m in (model, None):
            assert toxicity.score(frame, field).count() == n == quality_classifier.score(frame, m).count()
        said = langid.predict(frame, lang).collect()
        assert len(said) == n and langid.predict(frame, None).where("lang_pred <> 'und'").count() == 0
    none = labels.limit(0)
    assert toxicity.train(docs, none) is None and quality_classifier.train(docs, none) is None
    assert {r["lang_pred"] for r in langid.predict(odd_docs.where("doc_id in (2, 3, 4)"), lang).collect()} == {"und"}


def test_quality_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    assert accuracy(quality_classifier.query(spark, sf).collect(), spark.read.parquet(f"{sf}/labels.parquet"), "quality") > 0.95


def test_classifier_against_a_plain_model(spark, docs, labels):
    """Scores are sparse dot products over a text's n-grams, one by one in Python; training is FTRL, step by step."""
    rows = [(r["text"].encode(), r["quality"]) for r in docs.join(labels, "doc_id").where("text is not null").limit(30).collect()]
    w, bias = quality_classifier.fit_ftrl(rows, bits=12, epochs=2)
    z, n, zb, nb = defaultdict(float), defaultdict(float), 0.0, 0.0
    a, be, l1, l2 = 0.5, 1.0, 0.002, 0.05

    def vector(text):
        x = Counter()
        for slot, _ in quality_classifier.features([text], quality_classifier.OutlineMemo(), 12):
            for s in slot.tolist():
                x[s] += 1 / len(slot)
        return x

    def weight(s):
        return 0.0 if abs(z[s]) <= l1 else -(z[s] - np.sign(z[s]) * l1) / ((be + n[s] ** 0.5) / a + l2)

    for _ in range(2):
        for text, y in rows:
            x, b = vector(text), -zb / ((be + nb**0.5) / a)
            wi = {s: weight(s) for s in x}
            g = 1 / (1 + np.exp(-(sum(wi[s] * v for s, v in x.items()) + b))) - y
            for s, v in x.items():
                z[s] += g * v - ((n[s] + (g * v) ** 2) ** 0.5 - n[s] ** 0.5) / a * wi[s]
                n[s] += (g * v) ** 2
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / a * b
            nb += g * g
    assert bias == pytest.approx(-zb / ((be + nb**0.5) / a), rel=1e-6)
    assert all(w[s] == pytest.approx(weight(s), rel=1e-4, abs=1e-6) for s in list(z))
    frame = docs.limit(20)
    model = quality_classifier.train(docs, labels)
    for r in quality_classifier.score(frame, model).collect():
        memo, dot = quality_classifier.OutlineMemo(), 0.0
        for slot, _ in quality_classifier.features([(r["text"] or "").encode()], memo):
            dot += sum(float(model[0][s]) for s in slot.tolist()) / max(len(slot), 1)
        assert r["_score"] == pytest.approx(1 / (1 + np.exp(-np.clip(dot + model[1], -35, 35))), rel=1e-6)


def test_language_votes_against_a_plain_model(docs):
    """Family first, then the votes of its one-versus-one machines, each margin summed trigram by trigram."""
    model = langid.train(docs)
    for r in docs.where("text is not null").limit(15).collect():
        text = r["text"].encode()
        b = bytes(32 if c < 33 else c for c in b" " + text.lower() + b" ")
        counts = Counter(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - model.bits) for i in range(len(b) - 2))
        norm = sum(v * v for v in counts.values()) ** 0.5
        margin = lambda k: sum(v * model.weight(s, k) for s, v in counts.items()) / norm + float(model.bias[k])
        family = max(model.families, key=lambda f: margin(model.rest[f])) if model.rest else model.families[0]
        votes = Counter({x: 0 for x in model.members[family]})
        for (x, y), k in model.pairs.items():
            if x in votes and y in votes:
                votes[x if margin(k) > 0 else y] += 1
        said, _ = model.predict([text])
        assert votes[said[0]] == max(votes.values())


def test_unknown_languages_join_the_family_they_resemble():
    rng = np.random.default_rng(1)
    base = {f: np.abs(rng.normal(size=64)) ** 3 for f in ("g", "r", "new")}
    like = lambda f: base[f] + 0.05 * np.abs(rng.normal(size=64))
    got = langid.families_of({"en": like("g"), "de": like("g"), "fr": like("r"), "qa": like("r"), "qb": like("new"), "qc": like("new")})
    assert got["en"] == got["de"] == "germanic" and got["fr"] == got["qa"] == "romance"
    assert got["qb"] == got["qc"] == "qb"


def test_many_alike_languages_need_few_small_machines():
    """120 languages that share most words: families are divided, weights take little room, and texts are told apart."""
    import pickle

    rng = np.random.default_rng(2)
    shared = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    rows, held = [], []
    for k in range(120):
        own = ["".join(rng.choice(list("mnopqrst"), 4)) for _ in range(25)]
        texts = [" ".join([*rng.choice(shared, 30), *rng.choice(own, 15)]).encode() for _ in range(12)]
        rows += [(t, f"q{k:03d}") for t in texts[:10]]
        held += [(t, f"q{k:03d}") for t in texts[10:]]
    model = langid.Model(rows)
    assert max(map(len, model.members.values())) <= langid.MOST and len(model.bias) < 120 * langid.MOST
    assert len(pickle.dumps(model)) < 64 << 20
    said, _ = model.predict([t for t, _ in held])
    assert sum(a == b for a, (_, b) in zip(said, held)) > 0.9 * len(held)


def test_training_reaches_the_best_objective_of_a_plain_one():
    """Dual coordinate descent against subgradient steps on the same small problem."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.where(x @ rng.normal(size=12) + 0.05 * rng.normal(size=40) > 0, 1.0, -1.0)
    c = 20.0
    objective = lambda w: 0.5 * w @ w + c * np.maximum(0, 1 - y * (np.c_[x, np.full(40, 0.1)] @ w)).sum()
    w = langid.fit_svm([(np.arange(12), v) for v in x], y, bits=4, c=c, epochs=400)
    got = objective(np.append(w[:12], w[-1] / 0.1))
    wide, plain, best = np.c_[x, np.full(40, 0.1)], np.zeros(13), np.inf
    for t in range(1, 40_000):
        miss = y * (wide @ plain) < 1
        plain -= (plain - c * (y[miss, None] * wide[miss]).sum(0)) / t
        best = min(best, objective(plain))
    assert got <= 1.01 * best


def test_langid_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = [r for r in langid.query(spark, sf).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) / len(out) > 0.97


def test_columns_of_the_input_may_be_called_like_results(spark, docs, labels):
    frame = docs.limit(5).selectExpr("doc_id", "text", "1 AS _score", "'x' AS _spans", "2 AS _Kept", "3 AS _n_words", "4 AS __score", "5 AS _block")
    field, model = toxicity.train(docs, labels), quality_classifier.train(docs, labels)
    for out in (toxicity.score(frame, field), quality_classifier.score(frame, model), substring_dedup.dedup(frame)):
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        rows = out.select(*out.columns).collect()
        assert len(rows) == 5 and all(r["_score"] == 1 and r["_n_words"] == 3 and r["_Kept"] == 2 for r in rows)


# substrings


def brute_dedup(rows, width):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    seen, out = set(), Counter()
    for doc_id, text in order:
        w, gone = words(text), set()
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k in seen:
                gone.update(range(i, i + width))
            seen.add(k)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[doc_id, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("width,block,shard,span", [(20, 4 << 20, 1 << 20, 4096), (3, 2000, 300, 4)])
def test_substring_dedup_against_brute_force(odd_docs, docs, no_docs, width, block, shard, span):
    for frame in (docs, odd_docs):
        frame = frame.where("doc_id is not null")
        done = substring_dedup.dedup(frame.select("doc_id", "text", "lang"), width, block, shard, span=span).collect()
        got = Counter((r["doc_id"], r["_n_words"], r["_n_removed"], hashlib.sha256(r["_kept"].encode()).hexdigest()) for r in done)
        assert got == brute_dedup([(r["doc_id"], r["text"]) for r in frame.collect()], width)
    assert substring_dedup.dedup(no_docs.select("doc_id", "text")).count() == 0
    assert substring_dedup.dedup(odd_docs.select("doc_id", "text")).count() == odd_docs.count()


# quality rules


def brute_rules(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_counts(odd_docs, docs, no_docs):
    for frame in (odd_docs, docs):
        out = quality_rules.judge(frame).collect()
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out)
        assert got == Counter((r["doc_id"], *brute_rules(r["text"])) for r in frame.collect())
        for r in out:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(no_docs).count() == 0


# search


def brute_topk(rows, k, every=20):
    """(query, rank, id, score) in Python integers; scores saturate."""
    z = [(i, [int(np.floor(64.0 * x)) if abs(x) < 2**52 else 64 * int(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in z:
        if i % every == 0:
            s = [(min(max(sum(a * b for a, b in zip(q, p)), -(2**63)), 2**63 - 1), j) for j, p in z if j != i and len(p) == len(q)]
            out += [(i, n + 1, j, t) for n, (t, j) in enumerate(sorted(s, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


ODD_VECTORS = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (40, [1e300, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, []), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (9, [1.0, 0.0, 0.0])]


def test_topk_odd_vectors(spark):
    v = spark.createDataFrame([(i, x, 1) for i, x in ODD_VECTORS], "vec_id long, embedding array<double>, rank int")
    for shard in (3, 100):
        out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v, 3, shard_rows=shard).collect())
        assert out == brute_topk(ODD_VECTORS, 3)
        assert [x for x in out if x[0] == 20] == [(20, 1, 40, 2**63 - 1), (20, 2, 0, 2048), (20, 3, 7, 2048)]
    assert topk.top_k(v.limit(0)).count() == 0


def test_topk_with_components_of_any_size(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(160, 4))
    x[::7] *= 10.0 ** rng.integers(-300, 300, size=(len(x[::7]), 1))
    x[::20] *= 10.0 ** rng.integers(0, 12, size=(8, 1))
    x[3], x[60], x[80], x[100] = 1e9, 1e9, 1e308, -1e308
    x[120, 0], x[5] = 1e300, [1e308, 1.0, -1e308, 5e-324]
    rows = [(i, a.tolist()) for i, a in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (40, 1000):
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v, 12, shard_rows=shard).collect()) == brute_topk(rows, 12)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).round(1)
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    z = np.floor(64 * x).astype(int)
    want = []
    for q in range(0, 400, 20):
        s = z @ z[q]
        want += [(q, k + 1, j, int(s[j])) for k, j in enumerate(sorted((j for j in range(400) if j != q), key=lambda j: (-s[j], j))[:20])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v, shard_rows=64).collect()) == want


# join


def brute_components(rows, width, num):
    sets = {}
    for doc_id, text in rows:
        w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_join_against_brute_force(spark, docs, odd_docs, no_docs):
    rng = random.Random(11)
    base = [f"t{rng.randrange(400)}" for _ in range(60)]
    family = []
    for i in range(120):  # near copies whose similarity lies about the threshold, in chunks of 16
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(9999)}"
        family.append((1000 + i, " ".join(w)))
    shared = " ".join(f"s{i}" for i in range(30))
    family += [(2000 + i, shared + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 40)))) for i in range(60)]
    frame = spark.createDataFrame(family, "doc_id long, text string")
    for part, width, num, chunk in ((frame, 4, 85, 16), (frame, 2, 70, 16), (docs.select("doc_id", "text"), 4, 85, 2048), (odd_docs.where("doc_id is not null and doc_id <> 1").select("doc_id", "text"), 5, 80, 8)):
        want = brute_components([(r["doc_id"], r["text"]) for r in part.collect()], width, num)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(part, width, num, chunk=chunk).collect()}
        assert got == want
    odd = jaccard_join.join(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(r["component_id"] is None for r in odd if r["doc_id"] is None)
    assert {r["component_id"] for r in odd if r["doc_id"] in (1, 8)} == {1}
    assert jaccard_join.join(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


# sharding


def test_sharding_law_and_slots(odd_docs, docs, no_docs):
    for frame in (odd_docs, docs):
        out = sharding.assign_shards(frame).collect()
        by = defaultdict(list)
        for r in out:
            by[r["shard"]].append(r["slot"])
            assert r["law"] == "rows" and r["grown_shard"] is None
        counts = [len(by[s]) for s in range(24)]
        assert len(out) == frame.count() and max(counts) - min(counts) <= 1 and set(by) <= set(range(24))
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        sizes = Counter((r["doc_id"], r["size"]) for r in out)
        assert sizes == Counter((r["doc_id"], len((r["text"] or "").encode()) + 8) for r in frame.collect())
    assert sharding.assign_shards(no_docs).count() == 0


def plain_ring(rows, n_shards, vnodes, cells, position):
    """Shard and slot of every row by the law of the ring, row by row; position: (cell, order) of each."""
    owners = sharding.ring_owners(n_shards, vnodes, cells)
    bound = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    placed, late = [[] for _ in range(n_shards)], []
    for cell, key, row in sorted(position):
        if len(placed[owners[cell]]) < bound[owners[cell]]:
            placed[owners[cell]].append(row)
        else:
            late.append((cell, row))
    for cell, row in late:
        k = cell
        while len(placed[owners[k]]) >= bound[owners[k]]:  # clockwise to the next shard with room
            k = (k + 1) % cells
        placed[owners[k]].append(row)
    return placed


def test_sharding_against_a_plain_ring(spark, docs):
    """Checksums, and shards of all rows, against a model that puts rows on the ring one by one."""
    out = {r["doc_id"]: r for r in sharding.assign_shards(docs, 5, 8, 64).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[i]) and r["size"] == len(texts[i]) + 8 for i, r in out.items())
    keys = spark.createDataFrame([(i, r["text_crc32"], r["size"]) for i, r in out.items()], "i long, c long, s long").selectExpr("i", "xxhash64(cast(i as string), c, s, 0L) AS p").collect()
    position = [(((r["p"] & (2**64 - 1)) >> 20) % 64, (r["p"], r["i"]), r["i"]) for r in keys]
    model = plain_ring(out, 5, 8, 64, position)
    assert [len(x) for x in model] == [sum(r["shard"] == s for r in out.values()) for s in range(5)]
    first = {row: s for s, rows in enumerate(model) for row in rows}
    owners = sharding.ring_owners(5, 8, 64)
    home = {row: owners[cell] for cell, _, row in position}
    # Rows with room at home are there; the others are as far on the ring as the model says, shard by shard.
    assert Counter((home[i], r["shard"]) for i, r in out.items() if home[i] == r["shard"]) == Counter((home[i], s) for i, s in first.items() if home[i] == s)


def test_equal_rows_spread_over_the_ring(spark):
    rows = [(7, "same text")] * 2000 + [(None, None)] * 1000 + [(7, f"other {i}") for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sharding.assign_shards(f).drop("slot").collect() for f in (frame.repartition(3), frame.repartition(11)))
    assert Counter(map(str, one)) == Counter(map(str, two))
    assert max(Counter(r["shard"] for r in one).values()) == -(-3500 // 24)


def test_overflow_goes_clockwise_to_the_next_shard_with_room():
    owners = [0] * 4 + [1] * 4 + [2] * 4
    plan = sharding.bounded_walk({0: 10, 5: 1, 9: 1}, owners, 3)
    assert sum(b - a for _, a, b, _, _ in plan) == 12
    at0 = sorted((a, b, s) for c, a, b, s, _ in plan if c == 0)
    assert at0 == [(0, 4, 0), (4, 7, 1), (7, 10, 2)]


def test_few_rows_move_when_a_shard_is_added():
    before, after = sharding.ring_owners(24, 64), sharding.ring_owners(25, 64)
    moved = sum(a != b for a, b in zip(before, after)) / len(before)
    assert moved < 0.08 and all(b == 24 for a, b in zip(before, after) if a != b)
