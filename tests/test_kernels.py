"""Kernels against published values of the study and against invariants."""

import numpy as np
import pytest

from driftloom.config import SEEDS, StreamConfig, sensitivity_cells
from driftloom.kernels.kmeans import assign, squared, weighted_kmeans
from driftloom.kernels.methods import calibration_radius
from driftloom.kernels.subspace import Subspace, energy_rank, projection
from driftloom.kernels.summaries import Coreset, FadingClusters, MicroClusters, Resonance, TwoPools
from driftloom.plans.runner import learn
from driftloom.sources.controlled import causal_standardize, controlled_stream


@pytest.fixture(scope="module")
def controlled():
    x, y, turns = controlled_stream()
    assert turns == (3000, 6000) and np.bincount(y).sum() == 9000
    return causal_standardize(x), y


def rand_index(a, b):
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda v: (v * (v - 1) / 2).sum()
    i, j = pairs(table.sum(1)), pairs(table.sum(0))
    e = i * j / (len(a) * (len(a) - 1) / 2)
    return (pairs(table) - e) / ((i + j) / 2 - e)


# Mean rank, changes, last rank and chunk ARI of seed 7.
@pytest.mark.parametrize("method,rank,ari", [("proposed", 11.09811111, 0.76987355), ("fixed_rank", 8.0, 0.64746917)])
def test_controlled_run_equals_the_published_one(controlled, method, rank, ari):
    z, y = controlled
    steps, shots, counters, rows = learn(z, np.arange(len(z)), method, 7, {}, 1000)
    assert np.mean([s.rank for _, s in steps]) == pytest.approx(rank, abs=1e-8)
    if method == "proposed":
        ranks = np.array([s.rank for _, s in steps])
        assert counters["state_bytes"] == 398368 == 65536 + 275232 + 57600  # projection, subspace, clusters
        assert (np.diff(ranks) != 0).sum() == 5 and ranks[-1] == 12
    found = []
    for number, centers, weights, basis in shots[1:]:
        part = rows[number * 1000 : (number + 1) * 1000] @ basis @ basis.T
        found.append(rand_index(y[number * 1000 : (number + 1) * 1000], assign(part, weighted_kmeans(centers, weights, 4, 7))))
    assert np.mean(found) == pytest.approx(ari, abs=1e-6)


def test_calibration_and_final_state_equal_the_published_ones(controlled):
    z, _ = controlled
    radius = calibration_radius(z[50:550])
    assert radius == pytest.approx(10.411281070423867, abs=1e-9)
    pools = TwoPools(256, radius)
    pools.learn_all(z)
    told = pools.counters()
    assert (told["active"], told["outliers"]) == (143, 200)
    assert told["state_bytes"] / 2**20 == pytest.approx(0.6882476806640625)


def test_categories_equal_the_published_number(controlled):
    z, _ = controlled
    lo, hi = z[50:1000].min(0), z[50:1000].max(0)
    art = Resonance(256)
    art.learn_all(np.clip((z - lo) / (hi - lo + 1e-12), 0, 1))
    told = art.counters()
    assert told["categories"] == 3184 and told["state_bytes"] / 2**20 == pytest.approx(31.1180419921875)


def test_configuration_rules():
    assert StreamConfig.flat(original_dim=64).rank.most == 32 and len(SEEDS) == 10
    for bad in ({"original_dim": 0}, {"min_rank": 9}, {"max_rank": 40}, {"decay": 0.0}, {"projection_mode": "identity"}, {"leverage_mode": "x"}, {"window_size": 8}):
        with pytest.raises(ValueError):
            StreamConfig.flat(**({"original_dim": 64} | bad))
    with pytest.raises(ValueError):
        StreamConfig.flat(**{"original_dim": 3, "other": 1})
    cells = sensitivity_cells({"original_dim": 256})
    assert len(cells) == 15
    for _, _, p in cells:
        StreamConfig.flat(**p)


def test_projection_kinds():
    sparse = projection(StreamConfig.flat(original_dim=200, seed=3))
    assert set(np.round(np.unique(sparse), 9)) == set(np.round([-np.sqrt(3 / 32), 0, np.sqrt(3 / 32)], 9))
    assert abs((sparse == 0).mean() - 2 / 3) < 0.05
    assert projection(StreamConfig.flat(original_dim=200, projection_mode="dense")).std() == pytest.approx(1 / np.sqrt(32), rel=0.05)
    assert (projection(StreamConfig.flat(original_dim=32, projection_mode="identity")) == np.eye(32)).all()


def test_admission_only_filters_the_sketch():
    x = np.random.default_rng(123).normal(size=(180, 16))
    cfg = StreamConfig.flat(original_dim=16, projection_dim=8, window_size=128, max_rank=8, basis_update_interval=20, seed=1)
    space = Subspace(cfg)
    steps = [space.observe(z) for z in x @ projection(cfg)]
    assert space.seen == 180 and 0 < space.accepted < 180
    assert all(0.15 <= s.prob <= 1 and 4 <= s.rank <= 8 for s in steps)
    kept = [(z, 1.0) for z, _ in list(space.window)]
    assert len(kept) == min(128, space.accepted)
    z = x[0] @ projection(cfg)
    assert np.allclose(space.adapt(z), z @ space.basis @ space.basis.T)
    direct = sum(w * np.outer(v, v) for v, w in space.window)
    assert np.allclose(space.moment, direct)


def test_energy_rank_cases():
    assert energy_rank(np.array([5.0, 3.0, 1.0, 1.0]), 0.8, 1, 4) == 2
    assert energy_rank(np.zeros(4), 0.9, 2, 4) == 2 and energy_rank(np.ones(9), 0.95, 2, 4) == 4


def test_micro_clusters_policies():
    rng = np.random.default_rng(5)
    for prune in ("utility", "merge"):
        m = MicroClusters(2, 0.3, 10, 0.95, prune)
        m.learn_all(rng.normal(size=(300, 2)))
        centers, weights = m.snapshot()
        assert len(centers) <= 10 and (weights > 0).all()
        assert prune == "merge" or weights.max() <= 20  # the decay bounds what absorption adds up to
        assert m.nearest(centers[3]) == sorted(m.ids[: m.m])[3]
    one = MicroClusters(2, 0.5, 3)
    assert one.nearest(np.zeros(2)) == -1 and one.learn(np.zeros(2)) == 0 == one.learn(np.array([0.4, 0.0]))
    assert one.weight[0] == 2 and one.raw[0, 0] == pytest.approx(0.2)


def test_fading_clusters_find_two_blobs():
    rng = np.random.default_rng(5)
    f = FadingClusters(2, 0.35, 200)
    assert f.period == 259
    for i in range(160):
        f.learn(rng.normal(0 if i % 2 else 2, 0.05, 2))
    centers, _ = f.snapshot()
    assert len(centers) == 2 and np.allclose(sorted(centers[:, 0]), [0, 2], atol=0.1)
    with pytest.raises(ValueError):
        FadingClusters(2, 0.35, 200, beta=0.1, mu=6)


def test_coreset_keeps_its_mass():
    c = Coreset(2, 10, 20, seed=9)
    c.learn_all(np.random.default_rng(9).normal(size=(45, 2)))
    points, weights = c.snapshot()
    assert abs(weights.sum() - 45) < 1e-10 and len(points) < 20 and c.counters()["reductions"] > 0


def test_resonance_against_a_slow_model():
    rng = np.random.default_rng(123)
    x, art, protos = rng.random((120, 12)), Resonance(12), []
    for row in x:
        s = np.concatenate([row, np.sqrt(row)])
        code = np.concatenate([s, 1 - s])
        best, at = -1.0, None
        for j, p in enumerate(protos):
            m = np.minimum(p, code).sum()
            if m / code.sum() >= 0.8 and m / (0.001 + p.sum()) >= best:
                best, at = m / (0.001 + p.sum()), j
        if at is None:
            protos.append(code)
            at = len(protos) - 1
        else:
            protos[at] = np.minimum(protos[at], code)
        assert art.learn(row) == at
    assert np.allclose(art.prototype[: art.n], protos)


def test_kmeans_cases():
    x = np.array([[0.0, 0], [0, 1], [10, 0], [10, 1]])
    c = weighted_kmeans(x, np.array([1.0, 3, 1, 1]), 2, 7)
    assert sorted(map(tuple, c.round(6))) == [(0.0, 0.75), (10.0, 0.5)]
    assert np.allclose(weighted_kmeans(x, np.ones(4), 1, 7), x.mean(0))
    assert (assign(x, np.empty((0, 2))) == 0).all() and squared(x, x).diagonal().max() == 0
    assert len(weighted_kmeans(x[[0, 0, 0]], np.ones(3), 3, 7)) == 3
