"""Two-level prefix operators against plain windows, and text features against a slow model."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftloom.functions import text
from driftloom.operators import ordered, traces, vectors
from driftloom.sources import controlled


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_standardize_is_the_same_for_any_bucket(spark, size):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 3)) * [1.0, 1e-3, 1e4] + [0.0, 5.0, 1e6]
    x[:, 1][:60] = 5.0
    x[70:, 0] += 40
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "t long, features array<double>")
    got = vectors.causal_standardize(vectors.melt(s), size=size).toPandas().pivot(index="t", columns="dim", values="z").to_numpy()
    assert np.allclose(got, controlled.causal_standardize(x), rtol=1e-6, atol=1e-6)


def test_ranks_and_previous_values_across_buckets(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(c), int(rng.integers(9))) for c, k in enumerate(rng.integers(0, 3, 300))]
    df = spark.createDataFrame(rows, "g int, key int, v int")
    w = Window.partitionBy("g").orderBy("key")
    want = {(r["g"], r["key"]): (r["t"], r["p"]) for r in df.withColumn("t", F.row_number().over(w) - 1).withColumn("p", F.lag("v").over(w)).collect()}
    t = ordered.ranked(df, ["g"], F.floor(F.col("key") / 11), ["key"])
    got = ordered.previous(t, ["g"], "v", "p", 4)
    assert {(r["g"], r["key"]): (r["t"], r["p"]) for r in got.collect()} == want
    assert ordered.ranked(df, [], F.floor(F.col("key") / 11), ["key"]).where("t <> key").count() == 0
    moved = traces.changes(t.withColumnRenamed("v", "rank"), ["g"]).count()
    assert moved == df.withColumn("p", F.lag("v").over(w)).where("p <> v").count()


def test_prefixes_of_buckets_in_two_levels(spark):
    sums = spark.createDataFrame([(i, float(i)) for i in range(0, 200, 3)], "b long, x double")
    got = {r["b"]: r["x_before"] for r in ordered.before_buckets(sums, [], "b", ["x"], span=10).collect()}
    assert got == {b: float(sum(range(0, b, 3))) for b in range(0, 200, 3)}


# Published test vectors of the 32-bit hash.
@pytest.mark.parametrize("data,value", [(b"", 0), (b"test", 0xBA6BD213), (b"hello", 0x248BFA47), (b"The quick brown fox jumps over the lazy dog", 0x2E4FF723)])
def test_murmur3_vectors(data, value):
    assert text.murmur3(data) & 0xFFFFFFFF == value


@pytest.mark.parametrize("mode", ["md5", "murmur3"])
def test_features_of_words_of_any_script(spark, mode):
    rows = [(1, "Größe der GRÖSSE, été à l'été"), (2, "привет мир привет"), (3, "漢字 かな x 42"), (1, "another row of id one"), (None, "no id here"), (4, ""), (5, None)]
    out = text.hashed_features(spark.createDataFrame(rows, "doc_id long, text string"), 64, mode).collect()
    want = Counter()
    for i, t in rows:
        w = [x for x in re.findall(r"(?u)\b\w\w+\b", (t or "").lower())]
        grams = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        import hashlib

        slot = (lambda g: int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 64) if mode == "md5" else (lambda g: abs(text.murmur3(g.encode())) % 64)
        n = Counter(map(slot, grams))
        norm = sum(v * v for v in n.values()) ** 0.5
        want.update((i, s, round(v / norm, 9)) for s, v in n.items())
    assert Counter((r["doc_id"], r["slot"], round(r["value"], 9)) for r in out) == want
    with pytest.raises(ValueError):
        text.hashed_features(spark.createDataFrame(rows, "doc_id long, text string"), 64, "other")


def test_batch_forms_equal_the_joins_and_fall_back_to_them(spark):
    rng = np.random.default_rng(9)
    x, c = rng.normal(size=(60, 4)).round(1), rng.normal(size=(5, 4)).round(1)
    c[3] = c[1]  # a tie goes to the smaller center
    stream = spark.createDataFrame([(i, v.tolist(), float(i % 3 + 1)) for i, v in enumerate(x)], "t long, features array<double>, w double")
    centers = spark.createDataFrame([(10 * j, d, float(v)) for j, row in enumerate(c) for d, v in enumerate(row)], "center int, dim int, c double")
    d2 = np.round(((x[:, None] - c) ** 2).sum(2), 9)
    want = {(i, 10 * int(d2[i].argmin()), d2[i].min()) for i in range(60)}
    for rows in (1000, 3):
        assert {(r["t"], r["center"], r["d2"]) for r in vectors.nearest_rows(stream, centers, rows=rows).collect()} == want
        assert vectors.nearest_rows(stream, centers, ("w",), rows=rows).where("w = t % 3 + 1").count() == 60
        got = {(r["center"], r["dim"]): r["c"] for r in vectors.lloyd_rows(stream, centers, rows=rows).collect()}
        for j in range(5):
            own = d2.argmin(1) == j
            mean = np.average(x[own], axis=0, weights=(np.arange(60) % 3 + 1)[own]) if own.any() else c[j]
            assert np.allclose([got[10 * j, d] for d in range(4)], mean)
    assert vectors.nearest_rows(stream.limit(0), centers).count() == 0


def test_student_points_beyond_the_table(spark):
    # 97.5 % points for 31, 60 and 100 degrees of freedom.
    from driftloom.operators.paired import t975

    got = spark.createDataFrame([(31,), (60,), (100,)], "v int").select(t975(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in got] == pytest.approx([2.039513, 2.000298, 1.983972], abs=3e-6)


def test_sql_functions(spark):
    from driftloom.functions import sql
    from driftloom.operators.quality import partition_quality

    sql.register(spark)
    r = spark.sql("SELECT faded(4, 1, 2) AS f, admission_probability(9, 0.65, 0.15, 1) AS p, nearest_center(array(1D, 0D), array(array(5D, 5D), array(1D, 1D), array(1D, 1D))) AS i, squared_distance(array(0D, 3D), array(4D, 0D)) AS d").first()
    assert (r["f"], r["p"], r["i"], r["d"]) == (1.0, 1.0, 1, 25.0)
    rng = np.random.default_rng(4)
    rows = [(g, int(a), int(b)) for g in range(4) for a, b in rng.integers(0, 1 + g, (30, 2))]
    df = spark.createDataFrame(rows, "g int, y int, p int")
    want = {x["g"]: (x["ari"], x["nmi"]) for x in partition_quality(df, ["g"], "y", "p").collect()}
    got = {x["g"]: (x["a"], x["n"]) for x in df.groupBy("g").agg(F.expr("ari(y, p)").alias("a"), F.expr("nmi(y, p)").alias("n")).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=1e-12) for g in want)
    counts = df.union(df.where("y = 1")).groupBy("g", "y", "p").count()
    doubled = {x["g"]: (x["ari"], x["nmi"]) for x in partition_quality(df.union(df.where("y = 1")), ["g"], "y", "p").collect()}
    got = {x["g"]: (x["a"], x["n"]) for x in counts.groupBy("g").agg(F.expr("ari_of_counts(y, p, count)").alias("a"), F.expr("nmi_of_counts(y, p, count)").alias("n")).collect()}
    assert got.keys() == doubled.keys() and all(got[g] == pytest.approx(doubled[g], abs=1e-12) for g in got)
    df.createOrReplaceTempView("labelled")
    table = spark.sql("SELECT * FROM partition_quality(TABLE(SELECT g, y, p, count(*) AS n FROM labelled GROUP BY g, y, p) PARTITION BY g)").collect()
    assert {int(x["part"]): x["ari"] for x in table} == {g: pytest.approx(a, abs=1e-12) for g, (a, _) in want.items()}
    assert all(x["nmi"] == pytest.approx(want[int(x["part"])][1], abs=1e-12) for x in table)


def test_the_first_that_fits_may_not_be_the_nearest(spark):
    # The nearer cluster is already wide; the farther one stays within the radius.
    clusters = spark.createDataFrame([(0, 0, 0.0, 40.0, 10.0), (1, 0, 30.0, 90.5, 10.0)], "center int, dim int, ls double, ss double, w double")
    cells = spark.createDataFrame([(1, 0, 1.0), (2, 0, 90.0)], "t long, dim int, v double")
    assert {r["t"]: r["center"] for r in vectors.first_fitting(cells, clusters, 1.0).collect()} == {1: 1, 2: None}
