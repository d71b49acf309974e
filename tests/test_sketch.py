"""The sketch over a whole stream against NumPy and against the row-by-row state machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.config import StreamConfig
from driftloom.kernels.subspace import Subspace, energy_rank
from driftloom.operators import ordered, sketch

K = 8


def config(mode, window=200, interval=20, **more):
    return StreamConfig.flat(original_dim=K, projection_dim=K, projection_mode="identity", max_rank=6, initial_rank=3, min_rank=2, window_size=window, basis_update_interval=interval, leverage_mode=mode, retained_energy=0.8, seed=13, **more)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(1500, K)) * np.linspace(2, 0.2, K)
    z[700:] = z[700:, ::-1] * 1.5
    return z


@pytest.fixture(scope="module")
def stream(spark, values):
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "t long, features array<double>").repartition(5)


@pytest.mark.parametrize("seed", [7, 13])
def test_draws_are_the_generator_s_sequence(spark, seed):
    want = np.random.default_rng(seed).random(30_000)
    got = spark.range(30_000).repartition(7).where("id % 3 <> 1").select("id", sketch.draws(F.col("id"), seed).alias("u")).toPandas()
    assert len(got) == 20_000 and (got["u"].to_numpy() == want[got["id"].to_numpy()]).all()
    far = spark.createDataFrame([(10**12,), (5,)], "id long").select(sketch.draws(F.col("id"), seed).alias("u")).toPandas()["u"]
    assert far[1] == want[5] and 0 <= far[0] < 1


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
@pytest.mark.parametrize("width", [0, 3, 50])
def test_trailing_and_running_sums(spark, size, width):
    rng = np.random.default_rng(1)
    rows = [(g, t, float(rng.integers(0, 9))) for g in ("a", None) for t in range(130)]
    df = spark.createDataFrame(rows, "g string, t long, v double").repartition(3)
    got = ordered.trailing(df, ["g"], width, {"n": F.count("*"), "s": F.sum("v")}, size)
    got = {(r.g, r.t): (r.n, r.s) for r in got.collect()}
    total = {(r.g, r.t): r.c for r in ordered.running_sum(df, ["g"], F.col("v"), "c", size).collect()}
    for g in ("a", None):
        v = [x for k, _, x in rows if k == g]
        for t in range(130):
            part = v[max(0, t - width) : t + 1]
            assert got[g, t] == (len(part), sum(part)) and total[g, t] == sum(v[: t + 1])


@pytest.mark.parametrize("mode", ["uniform", "off"])
@pytest.mark.parametrize("window,interval", [(200, 20), (90, 20), (70, 35)])
def test_whole_stream_equals_the_state_machine(spark, stream, values, mode, window, interval):
    cfg = config(mode, window, interval)
    machine = Subspace(cfg)
    steps = [machine.observe(z) for z in values]
    rows = sketch.admitted(stream, cfg.admission, sketch.draws(F.col("t"), cfg.seed), size=256).checkpoint()
    got = rows.orderBy("t").collect()
    assert [r.accepted for r in got] == [s.accepted for s in steps]
    assert [r.prob for r in got] == [s.prob for s in steps]
    assert [r.ordinal for r in got] == np.cumsum([s.accepted for s in steps]).tolist()
    found = sketch.bases(rows.where("accepted"), cfg.admission, cfg.rank).orderBy("epoch").checkpoint()
    updates = [s for s in steps if s.updated]
    told = found.collect()
    assert len(told) == len(updates) > 10
    assert [(r.rank, r.candidate) for r in told] == [(s.rank, s.candidate_rank) for s in updates]
    assert np.allclose([r.error for r in told], [s.error for s in updates], atol=1e-9)
    assert np.allclose([r.threshold for r in told], [s.threshold for s in updates], atol=1e-9)
    first = sketch.first_refresh(cfg.rank, window)
    marked = rows.withColumn("epoch", sketch.epochs(rows, interval, first)).select("t", "features", "epoch")
    lev = sketch.leverage_under(marked, found).withColumn("leverage", F.coalesce("leverage", sketch.initial_leverage(F.col("features"), cfg.rank.first)))
    assert np.allclose([r.leverage for r in lev.orderBy("t").collect()], [s.leverage for s in steps], atol=1e-9)


def test_scores_under_the_first_basis(spark, stream, values):
    cfg = config("sample", 100, 5000)  # no refresh within the stream
    machine = Subspace(cfg)
    steps = [machine.observe(z) for z in values]
    scores = stream.withColumn("leverage", sketch.initial_leverage(F.col("features"), cfg.rank.first))
    rows = sketch.admitted(sketch.probabilities(scores, cfg.admission, size=128), cfg.admission, sketch.draws(F.col("t"), cfg.seed), size=128)
    got = rows.orderBy("t").collect()
    assert np.allclose([r.leverage for r in got], [s.leverage for s in steps], atol=1e-12)
    assert np.allclose([r.prob for r in got], [s.prob for s in steps], atol=1e-12)
    assert [r.accepted for r in got] == [s.accepted for s in steps]
    assert np.allclose([r.weight for r in got], [s.weight for s in steps], atol=1e-9)


def test_moments_spectra_and_errors_of_every_window(spark, stream, values):
    c = config("off", 100, 40)
    rows = sketch.admitted(stream, c.admission, F.lit(0.0)).withColumn("weight", 1.0 + F.col("t") % 5)
    w = 1.0 + np.arange(1500) % 5
    cells = sketch.window_moments(rows, c.admission, 40, size=4).toPandas()
    found = {r.refresh: r for r in sketch.spectra(sketch.window_moments(rows, c.admission, 40), c.rank).collect()}
    missed = {r.refresh: r for r in sketch.errors(sketch.spectra(sketch.window_moments(rows, c.admission, 40), c.rank)).collect()}
    assert sorted(found) == list(range(1, 38)) and len(cells) == 37 * K * (K + 1) // 2
    basis = np.eye(K)
    for m in range(1, 38):
        at = slice(max(0, 40 * m - 100), 40 * m)
        want = (values[at] * w[at, None]).T @ values[at] / w[at].sum()
        got = cells[cells.refresh == m].sort_values("cell")["c"].to_numpy()
        assert np.allclose(got, want[np.triu_indices(K)], rtol=1e-9, atol=1e-12)
        spectrum = np.sort(np.linalg.eigvalsh(want))[::-1]
        assert np.allclose(found[m]["values"], spectrum, atol=1e-9)
        assert found[m].candidate == energy_rank(spectrum, c.rank.energy, c.rank.least, c.rank.most)
        for r in (1, 3, K):
            part = basis[:, :r]
            direct = values[at] - values[at] @ part @ part.T
            e = np.sqrt((w[at, None] * direct**2).sum() / (w[at, None] * values[at] ** 2).sum())
            assert abs(missed[m].errors[r - 1] - e) < 1e-7
        basis = np.reshape(found[m].vectors, (K, K)).T


def test_empty_stream_and_short_windows(spark, stream):
    c = config("off", 40, 20)  # the window never holds enough rows for a refresh
    rows = sketch.admitted(stream, c.admission, F.lit(0.0))
    assert sketch.first_refresh(c.rank, 40) == 0 and sketch.bases(rows, c.admission, c.rank).count() == 0
    none = sketch.admitted(stream.limit(0), c.admission, F.lit(0.0))
    assert sketch.bases(none, config("off").admission, c.rank).count() == 0
    with pytest.raises(ValueError):
        sketch.admitted(stream, type(c.admission)(mode="other"), F.lit(0.0))


def test_registered_run_equals_the_state_machine(spark, sf_dir):
    from driftloom.kernels.subspace import projection
    from driftloom.plans import sketch_queries as q
    from driftloom.sources import tables

    cfg = q.MOMENTS
    rows = tables.embeddings(spark, sf_dir).orderBy("t").toPandas()
    z = np.array(rows["features"].tolist()) @ projection(q.CFG)
    machine = Subspace(cfg)
    steps = [machine.observe(x) for x in z]
    updates = [s for s in steps if s.updated]
    told = q.basis_query(spark, sf_dir).orderBy("epoch").collect()
    assert len(told) == len(updates) > 5
    assert [(r.rank, r.candidate) for r in told] == [(s.rank, s.candidate_rank) for s in updates]
    assert np.allclose([r.error for r in told], [s.error for s in updates], atol=1e-9)
    scores = q.score_query(spark, sf_dir).orderBy("t").collect()
    assert np.allclose([r.leverage for r in scores], [s.leverage for s in steps], atol=1e-8)
