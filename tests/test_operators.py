"""Edge cases of metrics, statistics, sources, sinks and the streaming operator."""

import gzip
import io

import numpy as np
import pytest

from driftloom.config import StreamConfig
from driftloom.functions.text import hashed_features
from driftloom.kernels.methods import AdaptiveMethod
from driftloom.operators import paired, quality, traces, vectors
from driftloom.sources import controlled, files, sinks
from driftloom.streaming.stateful import RunningScale, drain, learn_stream, stream_files
from pyspark.sql import functions as F


def labels(spark, truth, pred):
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(truth, pred)], "y int, p int")


@pytest.mark.parametrize(
    "truth,pred,ari,nmi",
    [([0], [3], 1, 1), ([1, 1, 1], [2, 2, 2], 1, 1), ([0, 0, 1, 1], [5, 5, 9, 9], 1, 1), ([0, 0, 1, 1], [0, 1, 0, 1], -0.5, 0), ([0, 0, 0, 0], [0, 1, 2, 3], 0, 0)],
)
def test_quality_conventions(spark, truth, pred, ari, nmi):
    r = quality.partition_quality(labels(spark, truth, pred), [], "y", "p").first()
    assert (r["ari"], r["nmi"]) == pytest.approx((ari, nmi), abs=1e-9)


def test_standardize_equals_the_ordered_form(spark):
    x = np.random.default_rng(1).normal(size=(40, 3))
    x[:, 2] = 4.0
    x[5, 0] = np.nan
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "t long, features array<double>")
    got = vectors.causal_standardize(vectors.melt(s)).toPandas().pivot(index="t", columns="dim", values="z").to_numpy()
    assert np.allclose(got[:, 1:], controlled.causal_standardize(x)[:, 1:]) and np.isfinite(got).all()


def test_sparse_and_dense_projection_agree(spark):
    rng = np.random.default_rng(44)
    x = rng.normal(size=(12, 20))
    x[np.abs(x) < 0.8] = 0
    w = rng.normal(size=(20, 4))
    omega = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(20) for j in range(4)], "dim int, j int, w double")
    dense = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "t long, features array<double>")
    cells = vectors.melt(dense)
    a = vectors.project(cells, omega).toPandas().pivot(index="t", columns="j", values="z").fillna(0).to_numpy()
    b = vectors.project(cells.where("v <> 0"), omega).toPandas().pivot(index="t", columns="j", values="z").fillna(0).to_numpy()
    c = np.stack(vectors.project_batches(dense, w).orderBy("t").toPandas()["features"].to_numpy())
    assert np.allclose(a, x @ w) and np.allclose(b, x @ w) and np.allclose(c, x @ w)


def test_signed_rank_table():
    t = paired.signed_rank_table(10)
    assert t[0] == pytest.approx(0.001953125) and t[3] == pytest.approx(0.009765625) and t[18] == pytest.approx(0.375) and max(t) == 1


def test_published_paired_statistics(spark):
    d = [0.03, 0.06, 0.01, 0.05, 0.02, 0.07, -0.004, 0.04, -0.003, 0.08]
    runs = spark.createDataFrame([("x", i, v, 0.0) for i, v in enumerate(d)], "f string, seed int, a double, b double")
    r = paired.holm(paired.with_exact_p(paired.paired(runs, "f", "a", "b"), 10)).first()
    assert (r["wins"], r["losses"], r["w"]) == (8, 2, 3.0) and r["p"] == pytest.approx(0.009765625) == r["p_holm"]
    assert r["rank_biserial"] == pytest.approx(0.6)
    half = 2.262157 * np.std(d, ddof=1) / np.sqrt(10)
    assert (r["low"], r["high"]) == pytest.approx((np.mean(d) - half, np.mean(d) + half))


def test_hashed_features_have_unit_length(spark):
    d = spark.createDataFrame([(1, "The cat, the hat"), (2, ""), (3, None), (4, "a b")], "doc_id long, text string")
    h = hashed_features(d, 64)
    assert h.groupBy("doc_id").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()[0]["n"] == pytest.approx(1)
    assert {r["doc_id"] for r in h.collect()} == {1}


def test_record_errors_name_null_and_false(spark):
    d = spark.createDataFrame([(1, 1.0), (None, float("nan"))], "a int, b double")
    e = traces.record_errors({"a": F.col("a") == 1, "b": ~F.isnan("b")})
    assert [r["e"] for r in d.select(e.alias("e")).collect()] == [[], ["a", "b"]]


def test_file_sources(spark, tmp_path):
    with gzip.open(tmp_path / "cov.csv.gz", "wt") as f:
        f.write("1,2,3\n4,5,1\n")
    rows = files.read_headerless_csv(spark, str(tmp_path / "cov.csv.gz"), 2).orderBy("t").collect()
    assert [(r["features"], r["label"]) for r in rows] == [([1.0, 2.0], 2), ([4.0, 5.0], 0)]
    arff = tmp_path / "e.arff"
    arff.write_text("% note\n@relation x\n@data\n" + ",".join(["1"] * 8) + ",UP\n" + ",".join(["2"] * 8) + ",'down'\n")
    assert [r["label"] for r in files.read_arff(spark, str(arff)).orderBy("t").collect()] == [1, 0]
    arff.write_text(",".join(["1"] * 8) + ",SIDEWAYS\n")
    with pytest.raises(Exception, match="unknown label"):
        files.read_arff(spark, str(arff)).collect()
    for name, text in (("a.txt", "one\ntwo\n"), ("a.lab", "0\n2\n"), ("b.txt", "three"), ("b.lab", "1")):
        (tmp_path / name).write_text(text)
    pairs = [(str(tmp_path / "a.txt"), str(tmp_path / "a.lab")), (str(tmp_path / "b.txt"), str(tmp_path / "b.lab"))]
    got = files.read_text_splits(spark, pairs, [2, 1]).orderBy("split", "line").collect()
    assert [(r["split"], r["text"], r["label"]) for r in got] == [(0, "one", 0), (0, "two", 2), (1, "three", 1)]
    with pytest.raises(ValueError):
        files.read_text_splits(spark, pairs, [3, 1])
    blob = io.BytesIO()
    np.savez_compressed(blob, x=np.ones((3, 2)), y=np.array([0, 1, 1]))
    (tmp_path / "d.npz").write_bytes(blob.getvalue())
    path = str(tmp_path / "d.npz")
    digest = files.digests(spark, path).first()["sha256"]
    df = files.check_shape(files.read_npz(spark, path, 3, digest), 3, 2)
    assert df.count() == 3
    with pytest.raises(RuntimeError):
        files.verified_bytes(spark, path, "0" * 64)
    with pytest.raises(ValueError):
        files.check_shape(df, 3, 5)
    missing = str(tmp_path / "none.npz")
    assert files.read_first(spark, [lambda: files.read_npz(spark, missing), lambda: df]).count() == 3
    with pytest.raises(FileNotFoundError):
        files.read_first(spark, [lambda: files.read_npz(spark, missing)])
    (tmp_path / "r.csv").write_bytes(b"\xef\xbb\xbfmethod,ari\nx,1\n")
    assert files.read_results_csv(spark, str(tmp_path / "r.csv")).columns == ["method", "ari"]
    (tmp_path / "c.json").write_bytes(b'\xef\xbb\xbf{"a": 1}')
    assert files.read_json_or_empty(spark, str(tmp_path / "c.json")) == {"a": 1} and files.read_json_or_empty(spark, missing) == {}


def test_sinks_are_guarded_and_resumable(spark, tmp_path):
    runs = spark.createDataFrame([("d", "m", 7, 0.5)], "dataset string, method string, seed int, ari double")
    good = f"{tmp_path}/results/execution_runs/x"
    for bad in (f"{tmp_path}/results/main_results/x", f"{tmp_path}/elsewhere", f"{tmp_path}/results/execution_runs/../main_results/x"):
        with pytest.raises(ValueError):
            sinks.write_runs(runs, bad)
    sinks.write_runs(runs, good)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_runs(runs, good)
    sinks.write_runs(runs, good, force=True)
    keys = ["dataset", "method", "seed"]
    plan = spark.createDataFrame([("d", "m", 7), ("d", "m", 13)], "dataset string, method string, seed int")
    done = spark.read.json(good)
    assert [r["seed"] for r in sinks.still_to_run(plan, done, keys).collect()] == [13]
    m = sinks.manifest(done, plan, keys).first()
    assert (m["expected"], m["present"], m["missing"], m["complete"]) == (2, 1, 1, False)


def test_controlled_source_equals_the_arrays(spark):
    x, y, _ = controlled.controlled_stream(90, 32)
    rows = controlled.read_controlled(spark, rows=90, width=32, slices=3).orderBy("t").collect()
    assert np.allclose([r["features"] for r in rows], x) and [r["label"] for r in rows] == y.tolist()


def test_any_split_into_batches_gives_one_trace(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(150, 16))
    params = {"original_dim": 16, "projection_dim": 16, "projection_mode": "identity", "max_rank": 16, "window_size": 64, "seed": 7}
    method, scale = AdaptiveMethod(StreamConfig.flat(**params)), RunningScale()
    want = [(t, *[f(v) for f, v in ((int, mc), (int, s.rank))]) for t, (mc, s) in enumerate(method.learn(scale.scale(v)) for v in x)]
    schema = "run string, t long, features array<double>"
    for name, cuts in (("one", [0, 150]), ("many", [0, 20, 90, 150])):
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = spark.createDataFrame([("r", t, x[t].tolist()) for t in range(a, b)] + ([("r", 3, x[3].tolist())] if k else []), schema)
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            drain(learn_stream(stream_files(spark, f"{tmp_path}/{name}/in", schema), {"r": params}), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/state")
        got = spark.read.parquet(f"{tmp_path}/{name}/out").orderBy("t").collect()
        assert [(r["t"], r["mc_id"], r["rank"]) for r in got] == want
        assert max(r["late"] for r in got) == len(cuts) - 2
