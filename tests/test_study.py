"""Study files, loaders, consistency checks, the runner's pieces, and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom import cli
from driftloom.config import STUDY_KEYS, StreamConfig, read_study
from driftloom.operators import checks, vectors
from driftloom.plans import run_queries, runner
from driftloom.sources import files, study


def test_study_file(tmp_path):
    values = StreamConfig.flat(original_dim=54).to_dict()
    raw = {k: values[k] for k in STUDY_KEYS} | {"dataset": "covertype", "n_clusters": 7, "baseline_settings": {"clustream": {"radius": 1.5}}, "other": 1}
    path = tmp_path / "covertype.json"
    path.write_text(json.dumps(raw))
    got = read_study(str(path), "covertype")
    assert (got.classes, got.others["clustream"]["radius"], len(got.values)) == (7, 1.5, 12)
    cfg = got.config(54, 13, fixed_rank=True)
    assert (cfg.rank.first, cfg.rank.most, cfg.seed, cfg.projection.seed, cfg.clusters.shrink) == (8, 8, 13, 13, 0.0)
    assert cfg == StreamConfig.for_dataset("covertype", 54, 13, fixed_rank=True)
    path.write_text(json.dumps({k: v for k, v in raw.items() if k != "decay"}))
    with pytest.raises(ValueError, match="decay"):
        read_study(str(path))
    with pytest.raises(FileNotFoundError):
        read_study(str(tmp_path / "none.json"))


def test_row_archive_is_never_dense(spark, tmp_path):
    x = np.array([[0.0, 2, 0], [0, 0, 0], [1, 0, 4]])
    starts, at = [0, 1, 1, 3], [1, 0, 2]
    np.savez(tmp_path / "x.npz", data=[2.0, 1, 4], indices=at, indptr=starts, shape=x.shape)
    cells = study.read_csr(spark, str(tmp_path / "x.npz"))
    assert {(r["t"], r["dim"], r["v"]) for r in cells.collect()} == {(0, 1, 2.0), (2, 0, 1.0), (2, 2, 4.0)}
    assert {(r["t"], r["dim"], r["z"]) for r in vectors.sparse_range_scale(cells).collect()} == {(0, 1, 1.0), (2, 0, 1.0), (2, 2, 1.0)}
    with pytest.raises(Exception, match="negative value in dim 1"):
        vectors.sparse_range_scale(cells.withColumn("v", F.when(F.col("dim") == 1, -1.0).otherwise(F.col("v")))).collect()
    np.savez(tmp_path / "bad.npz", data=[2.0], indices=[5], indptr=starts, shape=x.shape)
    with pytest.raises(ValueError):
        study.read_csr(spark, str(tmp_path / "bad.npz"))


def test_loader_prefers_prepared_files_and_asks_for_packaged_text(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        study.load(spark, str(tmp_path), "electricity")
    with pytest.raises(FileNotFoundError, match="asked for"):
        study.load(spark, str(tmp_path), "tweeteval")
    with pytest.raises(ValueError):
        study.load(spark, str(tmp_path), "other")
    got = study.load(spark, str(tmp_path), "synthetic_gmm")
    assert got.source == "generated" and got.labels.count() == 9000
    (tmp_path / "packaged").mkdir()
    np.savez(tmp_path / "packaged" / "electricity.npz", x=np.zeros((5, 8)), y=np.zeros(5, int))
    with pytest.raises(ValueError):  # there, but not of the right size
        study.load(spark, str(tmp_path), "electricity")


def test_rows_and_labels_are_a_pair(spark):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "t long, features array<double>")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "t long, label int")
    assert [r["label"] for r in study.paired_by_position(rows, labels).orderBy("t").collect()] == [0, 1, 0, 1]
    for a, b in ((rows.where("t < 3"), labels), (rows, labels.where("t > 0"))):
        with pytest.raises(Exception, match="rows and labels differ"):
            study.paired_by_position(a, b).collect()
    predicted = rows.select("t", F.lit(1).alias("pred"))
    with pytest.raises(Exception, match="no label for the row with t = 3"):
        runner.with_labels(predicted, labels.where("t < 3")).collect()


def test_arff_columns_are_compared_by_name(spark, tmp_path):
    head = "@relation e\n" + "".join(f"@attribute {c} real\n" for c in files.ELECTRICITY) + "@data\n"
    good, bad = tmp_path / "good.arff", tmp_path / "bad.arff"
    good.write_text(head + "1,2,3,4,5,6,7,8,UP\n")
    bad.write_text(head.replace("nswprice", "price") + "1,2,3,4,5,6,7,8,UP\n")
    assert files.read_arff(spark, str(good)).first()["label"] == 1
    with pytest.raises(ValueError, match="columns"):
        files.read_arff(spark, str(bad))


def test_consistency_checks(spark):
    records = spark.createDataFrame([("a", s, 0.5 + s / 10, 0.2) for s in range(4)] + [("b", 0, 0.1, 0.1)], "method string, seed int, ari double, nmi double")
    mean, sd = 0.65, float(np.std([0.5, 0.6, 0.7, 0.8], ddof=1))
    summary = lambda m: spark.createDataFrame([("a", m, sd, 0.2, 0.0), ("c", 1.0, 0.0, 1.0, 0.0)], "method string, ari_mean double, ari_sd double, nmi_mean double, nmi_sd double")
    bad = checks.summary_mismatches(records, summary(mean), ["method"], ["ari", "nmi"], 4, 1e-9)
    assert {r["method"] for r in bad.collect()} == {"b", "c"}
    bad = checks.summary_mismatches(records.where("method = 'a'"), summary(0.66).where("method = 'a'"), ["method"], ["ari", "nmi"], 4, 1e-9)
    assert [(r["what"], r["told"]) for r in bad.collect()] == [("ari_mean", 0.66)]
    macro = spark.createDataFrame([("a", 0.2, 0.4, 0.3), ("b", 0.2, 0.4, 0.5)], "m string, x double, y double, xy double")
    assert [r["m"] for r in checks.macro_mismatches(macro, ["m"], ["x", "y"], "xy").collect()] == ["b"]
    one, two = (spark.createDataFrame([(x,) for x in s], "name string") for s in ("abc", "bcd"))
    assert {(r["name"], r["side"]) for r in checks.set_difference(one, two, ["name"]).collect()} == {("a", "listed"), ("d", "found")}
    assert checks.set_difference(one, one, ["name"]).count() == 0
    runs = records.union(records.where("method = 'a'").withColumn("method", F.lit("c")))
    assert checks.disagreements(runs, ["seed"], "method", "a", "c", ["ari", "nmi"]).count() == 0
    assert [r["seed"] for r in checks.disagreements(runs, ["seed"], "method", "a", "b", ["ari"]).collect()] == [0]


def test_the_checks_of_a_run_record(spark):
    from driftloom.operators.traces import record_errors

    good = (checks.RECORD_SCHEMA, "d", "m", 7, True, 1.0, 0.1, 0.2, 0.3, 0.4)
    rows = [good, ("other", "d", "m", 7, True, 1.0, 0.1, 0.2, 0.3, 0.4), good[:4] + (False, 0.5, float("nan"), None, float("inf"), 0.4)]
    names = "schema string, dataset string, method string, seed int, full_stream boolean, coverage double, online_chunk_mean_ari double, online_chunk_mean_nmi double, complete_window_final_ari double, complete_window_final_nmi double"
    df = spark.createDataFrame(rows, names)
    got = [r["e"] for r in df.select(record_errors(checks.record_checks(F.lit("d"), F.lit("m"), F.lit(7))).alias("e")).collect()]
    assert got == [[], ["schema"], ["full_stream", "coverage", "metric:online_chunk_mean_ari", "metric:online_chunk_mean_nmi", "metric:complete_window_final_ari"]]


@pytest.mark.parametrize("method", ["proposed", "streamkmpp", "twstream", "fra_art"])
def test_runs_in_pieces_equal_runs_in_memory(spark, method):
    rng = np.random.default_rng(5)
    x, t = rng.normal(size=(230, 8)), np.arange(230)
    params = {"projection_dim": 8, "max_rank": 8, "window_size": 64} if method == "proposed" else {}
    steps, shots, counters, z = runner.learn(x, t, method, 7, params, 50, calibration=60)
    run = runner.Run(method, 7, params, 50, calibration=60)
    done = [c for a in range(0, 230, 33) for c in run.feed(t[a : a + 33], x[a : a + 33])] + list(run.feed(t[:0], x[:0], last=True))
    assert [c.number for c in done] == [0, 1, 2, 3, 4] and np.allclose(np.concatenate([c.z for c in done]), z)
    assert run.model.counters() == counters and all(np.allclose(c.centers, s[1]) for c, s in zip(done, shots))
    stream = spark.createDataFrame([(int(i), v.tolist(), int(i % 2)) for i, v in zip(t, x)], "t long, features array<double>, label int").repartition(5)
    cells = runner.run_cells(spark, [(method, s, "v", params) for s in (7, 13)])
    rows = runner.run_matrix(stream, cells, 50).collect()
    final = [json.loads(r["counters"]) for r in rows if r["kind"] == "final"]
    assert len(final) == 2 and sum(r["kind"] == "step" for r in rows) == (460 if method == "proposed" else 0)
    one = runner.predictions(stream, cells, 2, 50)
    assert one.count() == 2 * 180 and one.agg(F.min("chunk")).first()[0] == 1
    whole = runner.predictions(stream, cells, 2, 50, final=True)
    assert whole.count() == 460 and whole.where("chunk <> -1").count() == 0
    assert runner.evaluate(stream, cells, 2, 500).count() == 2  # a stream of one chunk is scored


def test_controlled_drift_equals_the_published_run(spark):
    """Rank telemetry of seed 7 on the generated stream, and the drifts' answers."""
    r = run_queries.rank_summary(spark, (7,)).first()
    assert (r["rank_mean"], r["rank_changes"], r["rank_final"]) == (pytest.approx(11.09811111, abs=1e-8), 5, 12)


def test_command_line(spark, tmp_path, capsys):
    out = str(tmp_path / "results" / "execution_runs" / "a")
    assert cli.main(["run-drift", "--out", out, "--dry-run", "--seeds", "7"]) == 0
    assert [r["drift"] for r in json.loads(capsys.readouterr().out)] == [3000, 6000]
    assert cli.main(["run-sensitivity", "--out", out, "--dry-run"]) == 0 and len(json.loads(capsys.readouterr().out)) == 15
    data = str(tmp_path / "stream.parquet")
    rng = np.random.default_rng(1)
    spark.createDataFrame([(i, rng.normal(i % 2 * 5, 0.1, 4).tolist(), i % 2) for i in range(80)], "t long, features array<double>, label int").write.parquet(data)
    go = ["run", "--data", data, "--classes", "2", "--out", out, "--methods", "clustream", "--seeds", "7", "--chunk", "20"]
    assert cli.main(go) == 0 and cli.main(go) == 0  # the second time there is nothing left to run
    assert spark.read.json(out).count() == 1
    assert cli.main(["summarize", "--out", out]) == 0
    capsys.readouterr()
    with pytest.raises(ValueError):
        cli.main(["run", "--data", data, "--classes", "2", "--out", str(tmp_path / "elsewhere")])
    (tmp_path / "one.txt").write_text("x")
    listed = files.digests(spark, str(tmp_path / "one.txt")).first()
    manifest = tmp_path / "manifest.csv"
    manifest.write_text("﻿path,sha256\n" + f"a/one.txt,{listed['sha256']}\n", encoding="utf-8")
    assert cli.main(["verify-manifest", "--data", str(tmp_path / "one.txt"), "--manifest", str(manifest)]) == 0
    (tmp_path / "one.txt").write_text("y")
    assert cli.main(["verify-manifest", "--data", str(tmp_path / "one.txt"), "--manifest", str(manifest)]) == 1
    records, summary = tmp_path / "records", tmp_path / "summary.csv"
    records.mkdir()
    for s, v in ((1, 0.2), (2, 0.4)):
        (records / f"{s}.json").write_text(json.dumps({"method": "m", "seed": s, "ari": v}))
    summary.write_text(f"method,ari_mean,ari_sd\nm,{np.mean([0.2, 0.4])},{np.std([0.2, 0.4], ddof=1)}\n")
    check = ["verify", "--records", str(records), "--summary", str(summary), "--by", "method", "--metrics", "ari", "--runs"]
    assert cli.main([*check, "2"]) == 0 and cli.main([*check, "3"]) == 1
