"""Dense line numbers of raw files of several blocks and several files."""

import gzip

import pytest
from pyspark.sql import functions as F

from driftloom.sources import files, sinks


@pytest.fixture
def small_blocks(spark):
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_lines_of_many_blocks_have_dense_numbers(spark, tmp_path, small_blocks):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(2000)]
    path = tmp_path / "one.txt"
    path.write_bytes("\r\n".join(lines).encode() + b"\r\n")
    read = files.numbered_lines(spark, str(path))
    assert spark.read.text(str(path)).select(F.col("_metadata.file_block_start")).distinct().count() >= 3
    assert [tuple(r) for r in read.orderBy("t").collect()] == list(enumerate(lines))
    even = files.numbered_lines(spark, str(path), lambda x: F.length(x) % 2 == 0).orderBy("t").collect()
    assert [tuple(r) for r in even] == list(enumerate(x for x in lines if len(x) % 2 == 0))


def test_files_follow_each_other_by_name(spark, tmp_path, small_blocks):
    folder, want = tmp_path / "many", []
    folder.mkdir()
    for k, n in enumerate((300, 0, 1, 700)):
        part = [f"{k}-{i}" for i in range(n)]
        want += part
        (folder / f"part{k}.txt").write_text("\n".join(part))
    assert [tuple(r) for r in files.numbered_lines(spark, str(folder)).orderBy("t").collect()] == list(enumerate(want))


def test_csv_and_text_splits_of_many_blocks(spark, tmp_path, small_blocks):
    rows = [(i * 0.5, -i, 1 + i % 7) for i in range(1500)]
    (tmp_path / "plain.csv").write_text("".join(f"{a},{b},{c}\n" + ("\n" if i % 10 == 0 else "") for i, (a, b, c) in enumerate(rows)))
    got = files.read_headerless_csv(spark, str(tmp_path / "plain.csv"), 2).orderBy("t").collect()
    assert [(r.t, r.features, r.label) for r in got] == [(i, [a, float(b)], c - 1) for i, (a, b, c) in enumerate(rows)]
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as f:
        f.writelines(f"{a},{b},{c}\n" for a, b, c in rows)
    assert [r.t for r in files.read_headerless_csv(spark, str(tmp_path / "packed.csv.gz"), 2).orderBy("t").collect()] == list(range(1500))
    (tmp_path / "bad.csv").write_text("1,2,3\n1,x,3\n")
    with pytest.raises(Exception):
        files.read_headerless_csv(spark, str(tmp_path / "bad.csv"), 2).collect()
    texts = [f"text number {i} with words" for i in range(900)]
    (tmp_path / "t.txt").write_text("\n".join(texts) + "\n")
    (tmp_path / "l.txt").write_text("\n".join(str(i % 3) for i in range(900)) + "\n")
    part = files.read_text_splits(spark, [(str(tmp_path / "t.txt"), str(tmp_path / "l.txt"))], [900]).orderBy("line").collect()
    assert [(r.line, r.text, r.label) for r in part] == [(i, x, i % 3) for i, x in enumerate(texts)]


def test_a_resumed_job_leaves_one_record_for_each_run(spark, tmp_path):
    path = str(tmp_path / "results/execution_runs/all")
    runs = lambda seeds, ari: spark.createDataFrame([("d", "m", s, ari) for s in seeds], "dataset string, method string, seed int, ari double")
    read = lambda: sorted((r.seed, r.ari) for r in spark.read.json(path).collect())
    sinks.resume_runs(runs([7, 13], 0.1), path)
    sinks.resume_runs(runs([13, 19], 0.2), path)
    assert read() == [(7, 0.1), (13, 0.2), (19, 0.2)]
    dies = runs([19, 23], 0.3).withColumn("ari", F.when(F.col("seed") == 23, F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("ari")))
    with pytest.raises(Exception):
        sinks.resume_runs(dies, path)
    assert read() == [(7, 0.1), (13, 0.2), (19, 0.2)]
    sinks.resume_runs(runs([19, 23], 0.4), path)
    sinks.resume_runs(runs([19, 23], 0.4), path)
    assert read() == [(7, 0.1), (13, 0.2), (19, 0.4), (23, 0.4)]
    sinks.resume_runs(runs([7], 0.5), path, force=True)
    assert read() == [(7, 0.5)]
    with pytest.raises(ValueError):
        sinks.resume_runs(runs([7], 0.5), str(tmp_path / "elsewhere"))
