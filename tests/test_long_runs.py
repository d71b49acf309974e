"""Runs whose summaries grow with the stream: the same categories with a part of the comparisons, and summaries made only where they are read."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.kernels.summaries import Resonance
from driftloom.plans import runner


def rows_of_classes(n: int, dim: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.clip(0.5 + 0.17 * rng.standard_normal((n, dim)), -0.2, 1.2)
    x[n // 2 :: 7] = x[: len(x[n // 2 :: 7])]  # copies
    return x


@pytest.mark.parametrize("rate, power, dim", [(1.0, 0.5, 32), (0.7, 0.5, 32), (1.0, 2.0, 32), (1.0, 0.5, 1)])
def test_categories_of_blocks(rate, power, dim, monkeypatch):
    x = rows_of_classes(900, dim)
    x[500, 0] = np.nan  # matches nothing
    monkeypatch.setattr(Resonance, "TILE", 64)
    one, all_ = Resonance(dim, power, rate=rate), Resonance(dim, power, rate=rate)
    with np.errstate(invalid="ignore"):
        singly = [one.learn(z) for z in x]
        in_blocks = np.concatenate([all_.learn_all(x[a : a + 333]) for a in range(0, 900, 333)])
    assert singly == in_blocks.tolist()
    for name in ("prototype", "total", "count"):
        assert np.array_equal(getattr(one, name)[: one.n], getattr(all_, name)[: all_.n], equal_nan=True)


def test_few_categories_are_looked_at_closely():
    x, looked = rows_of_classes(3000, 64), [0, 0]

    class Counted(Resonance):
        def _place(self, x, code, among):
            looked[0] += len(among)
            looked[1] += self.n
            return super()._place(x, code, among)

    art = Counted(64)
    art.learn_all(x)
    assert art.n > 500 and looked[0] < looked[1] / 4


def test_summaries_are_made_where_they_are_read(spark):
    x = rows_of_classes(230, 4)
    stream = spark.createDataFrame([(t, row.tolist()) for t, row in enumerate(x)], "t long, features array<double>")
    cells = runner.run_cells(spark, [("fra_art", 7, "a", {}), ("clustream", 7, "a", {"radius": 0.2})])
    every, last = runner.run_matrix(stream, cells, 50), runner.run_matrix(stream, cells, 50, ("final",))
    assert {r["kind"] for r in last.collect()} == {"final"}
    told = lambda rows: sorted((r["method"], r["counters"]) for r in rows.where(F.col("kind") == "final").collect())
    assert told(every) == told(last)
    run = runner.Run("fra_art", 7, {}, 50, shots=False)
    chunks = list(run.feed(np.arange(230), x, last=True))
    assert [len(c.centers) for c in chunks] == [0] * 5 and run.model.n > 0


@pytest.mark.parametrize("rows, warmup", [(230, 1), (230, 0), (40, 1), (50, 1)])
def test_growing_summaries_are_scored_by_slices(spark, rows, warmup):
    from driftloom.kernels.kmeans import weighted_kmeans

    x = rows_of_classes(rows, 12)
    stream = spark.createDataFrame([(3 * t, row.tolist()) for t, row in enumerate(x)], "t long, features array<double>")
    cells = runner.run_cells(spark, [("fra_art", s, "a", {}) for s in (7, 13)])
    apart = runner.scored_apart(stream, cells, 3, 50, starts=2, steps=20, warmup=warmup, slices=3)
    got = {(r["seed"], r["t"]): (r["chunk"], r["pred"]) for r in apart.collect()}
    want = {}
    for seed in (7, 13):
        chunks = list(runner.Run("fra_art", seed, {}, 50).feed(3 * np.arange(rows), x, last=True))
        for c in chunks[warmup if len(chunks) > warmup else 0 :]:
            pred = runner.labels_of(c.z, None, weighted_kmeans(c.centers, c.weights, 3, seed, 2, 20))
            want |= {(seed, int(t)): (c.number, int(p)) for t, p in zip(c.t, pred)}
    assert got == want and len(got) > 0
    assert sorted(runner.predictions(stream, cells, 3, 50, 2, 20, warmup).collect()) == sorted(apart.collect())


@pytest.mark.parametrize("weights", ["counts", "wide"])
def test_few_rows_are_compared_while_centers_settle(weights, monkeypatch):
    from driftloom.kernels import kmeans

    rng = np.random.default_rng(5)
    x = np.clip(0.5 + 0.17 * rng.standard_normal((4000, 24)), 0.0, 1.0)
    x[3000:3200] = x[:200]  # copies
    w = rng.integers(1, 6, 4000).astype(float) if weights == "counts" else 10.0 ** rng.integers(-14, 4, 4000)
    compared, compare = [], kmeans.Owners._compare
    monkeypatch.setattr(kmeans.Owners, "_compare", lambda self, c, at: compared.append(len(x) if at is None else len(at)) or compare(self, c, at))
    for start in range(3):
        rows = kmeans.spread(x, w, np.random.default_rng(start))
        centers = x[[next(rows) for _ in range(8)]]
        plain, fast = kmeans.settle(x, w, centers, 300), kmeans.settle(x, w, centers, 300, kmeans.Owners(x, w))
        assert plain.cost == fast.cost and np.array_equal(plain.centers, fast.centers)
    if weights == "counts":
        assert len(compared) > 30 and sum(compared) < 0.6 * len(x) * len(compared)


def test_rows_that_single_precision_cannot_tell_apart():
    from driftloom.kernels import kmeans

    rng = np.random.default_rng(6)
    lattice, ones = rng.integers(0, 3, (3000, 3)).astype(float), np.ones(3000)  # many ties
    close = np.where(rng.random((3000, 1)) < 0.5, 1.0, 1.0 + 1e-9) * np.array([[1.0, 2.0]])
    close[::5] = 3.0
    for x in (lattice, close, 1e-3 * lattice):
        for steps in (1, 2, 50):
            centers = x[[0, 1, 2, 5, 7]]
            plain, fast = kmeans.settle(x, ones, centers, steps), kmeans.settle(x, ones, centers, steps, kmeans.Owners(x, ones))
            assert plain.cost == fast.cost and np.array_equal(plain.centers, fast.centers)
    few = np.ones((3000, 4))
    assert not kmeans.Owners.fit(few) and not kmeans.Owners.fit(lattice[:100]) and not kmeans.Owners.fit(lattice * np.nan) and not kmeans.Owners.fit(lattice * 1e20)
    assert not kmeans.Owners.fit(1e6 + 1e-2 * lattice) and kmeans.Owners.fit(lattice)


def test_slices_have_tasks_of_their_own(spark):
    x = rows_of_classes(230, 4)
    stream = spark.createDataFrame([(t, row.tolist()) for t, row in enumerate(x)], "t long, features array<double>")
    cells = runner.run_cells(spark, [("fra_art", s, "a", {}) for s in (7, 13)]).where("run >= 0")
    apart = runner.scored_apart(stream, cells, 3, 10, starts=1, steps=5, warmup=0, slices=6)
    per = apart.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.countDistinct("seed").alias("seeds"), F.countDistinct("chunk").alias("chunks")).collect()
    assert len(per) == 12 and {r["seeds"] for r in per} == {1} and max(r["chunks"] for r in per) < 12
