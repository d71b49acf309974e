"""Queries over whole tables against brute force."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from driftloom.operators import neighbors
from driftloom.plans import registry


@pytest.fixture(scope="module")
def points(sf_dir):
    e = pq.read_table(f"{sf_dir}/embeddings.parquet").sort_by("vec_id")
    return e.column("vec_id").to_numpy(), np.array(e.column("embedding").to_pylist(), np.float64)


def brute(ids, x, k, itself):
    """(i, j, d, place) of the k nearest by (d, j)."""
    out = []
    for i, v in zip(ids, x):
        d = np.round(np.sqrt(((x - v) ** 2).sum(1)), 9)
        near = [(a, int(j)) for a, j in zip(d, ids) if itself or j != i]
        out += [(int(i), j, a, p) for p, (a, j) in enumerate(sorted(near)[:k], 1)]
    return out


def test_neighbors_of_the_whole_table(spark, sf_dir, points):
    got = sorted((r["i"], r["place"], r["j"], r["d"]) for r in registry.QUERIES["knn_graph_whole"](spark, sf_dir).collect())
    want = sorted((i, p, j, d) for i, j, d, p in brute(*points, 8, False))
    assert len(want) > 150 * 8 and [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-6)


def test_neighbors_with_copies_and_few_rows(spark):
    x = np.random.default_rng(3).normal(size=(40, 5))
    x[5:25] = x[5]
    s = spark.createDataFrame([(i * 10, v.tolist()) for i, v in enumerate(x)], "t long, features array<double>")
    for n, itself in ((40, True), (40, False), (3, False), (0, True)):
        part = s.where(f"t < {10 * n}")
        got = sorted((r["i"], r["place"], r["j"]) for r in neighbors.pivot_neighbors(part, 6, itself, unit=7).collect())
        assert got == sorted((i, p, j) for i, j, _, p in brute([10 * i for i in range(n)], x[:n], 6, itself))


def test_radius_over_the_rows_of_the_reference(spark, sf_dir, points):
    ids, x = points[0][:1000], points[1][:1000]
    far = [d for _, _, d, p in brute(ids, x, 6, True) if p == 6]
    assert len(far) == min(1000, len(points[0])) > 150
    assert registry.QUERIES["calibration_radius_reference"](spark, sf_dir).first()["radius"] == pytest.approx(np.quantile(far, 0.8), abs=2e-6)


def test_confidence_of_every_row(spark, sf_dir, points):
    ids, x = points
    at, near = {int(i): v for i, v in zip(ids, x)}, {}
    for i, j, d, _ in brute(ids, x, 8, False):
        near.setdefault(i, []).append((j, d))
    w = {i: i % 5 + 1.0 for i in at}
    m, want = np.median(list(w.values())), {}
    for i, js in near.items():
        skew = np.abs(np.mean([at[j] > at[i] for j, _ in js], 0) - 0.5).mean() * 2
        sparse, change = min(np.mean([d for _, d in js]) / 1.2, 2.0), min(abs(w[i] - m) / m, 2.0)
        want[i] = min(1.0, max(0.05, 1 - (skew + sparse / 2 + change / 2) / 3))
    got = {r["i"]: r["confidence"] for r in registry.QUERIES["boundary_confidence_whole"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-6) for i in got)


@pytest.mark.parametrize("name,width", [("feature_subset_whole", 8), ("resonance_code_whole", 256), ("resonance_choice_whole", 1), ("outlier_limit_whole", 1)])
def test_every_row_is_there(spark, sf_dir, name, width):
    rows = pq.read_metadata(f"{sf_dir}/{'events' if name.startswith('outlier') else 'embeddings'}.parquet").num_rows
    assert registry.QUERIES[name](spark, sf_dir).count() == rows * width


def test_confidence_shuffles_vectors_and_not_cells(spark, sf_dir):
    plan = registry.QUERIES["boundary_confidence"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "collect_list" in plan
