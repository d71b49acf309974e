"""k-means and coresets over tables against the local ones."""

import numpy as np
import pytest

from driftloom.kernels.kmeans import squared, weighted_kmeans
from driftloom.operators import coreset, kmeans


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    centers = rng.normal(size=(8, 6)) * 4
    x = np.concatenate([c + rng.normal(size=(n, 6)) for c, n in zip(centers, (700, 400, 300, 200, 150, 120, 90, 40))])
    x = x[rng.permutation(len(x))]
    return x, 1.0 + np.arange(len(x)) % 4


@pytest.fixture(scope="module")
def rows(spark, data):
    x, w = data
    return spark.createDataFrame([(i, v.tolist(), float(m)) for i, (v, m) in enumerate(zip(x, w))], "t long, features array<double>, w double").repartition(4).cache()


def cost(x, w, centers):
    return float(w @ squared(x, centers).min(1))


def test_objective_is_that_of_the_local_one(rows, data):
    x, w = data
    centers, told = kmeans.table_kmeans(rows, 8, 7, starts=4, steps=40)
    assert told == pytest.approx(cost(x, w, centers), rel=1e-9)
    assert told <= 1.02 * cost(x, w, weighted_kmeans(x, w, 8, 7, starts=10, steps=300))
    again, _ = kmeans.table_kmeans(rows.repartition(7), 8, 7, starts=4, steps=40)
    assert np.allclose(centers, again, atol=1e-9)


def test_given_centers_move_as_locally(rows, data):
    x, w = data
    first = x[:5].copy()
    got, _ = kmeans.table_kmeans(rows, 5, 0, steps=3, initial=[first])
    c = first
    for _ in range(3):
        own = squared(x, c).argmin(1)
        c = np.stack([np.average(x[own == j], axis=0, weights=w[own == j]) if (own == j).any() else c[j] for j in range(5)])
    assert np.allclose(got, c, atol=1e-9)


def test_few_rows_copies_and_none(spark, rows):
    assert kmeans.table_kmeans(rows.limit(0), 3, 1) is None
    same = spark.createDataFrame([(i, [1.0, 2.0], 1.0) for i in range(50)], "t long, features array<double>, w double")
    centers, told = kmeans.table_kmeans(same, 3, 1, starts=2, steps=5)
    assert told == 0 and np.allclose(centers, [1.0, 2.0])
    with pytest.raises(ValueError):
        kmeans.seeds(rows, 10**6, 1, 10)


@pytest.mark.parametrize("seed", range(3))
def test_coreset_keeps_mass_and_cost(rows, data, seed):
    x, w = data
    points = coreset.coreset_tree(rows, size=200, bucket=250, seed=seed).orderBy("place").toPandas()
    c, m = np.stack(points["features"].to_numpy()), points["w"].to_numpy()
    assert len(points) == 200 and m.sum() == pytest.approx(w.sum(), rel=1e-12)
    whole, part = weighted_kmeans(x, w, 8, 3, starts=10, steps=100), weighted_kmeans(c, m, 8, 3, starts=10, steps=100)
    assert cost(x, w, part) <= 1.1 * cost(x, w, whole)
    again = coreset.coreset_tree(rows.repartition(3), size=200, bucket=250, seed=seed).orderBy("place").toPandas()
    assert np.array_equal(np.stack(again["features"].to_numpy()), c)


def test_small_tables_are_their_own_coreset(spark, rows):
    assert coreset.coreset_tree(rows.where("t < 30"), size=50, bucket=20).count() == 30
    assert coreset.coreset_tree(rows.limit(0)).count() == 0
