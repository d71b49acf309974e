"""Interval joins by bins and the search for the first chunk that reaches a target, against plain loops."""

import numpy as np
import pytest

from driftloom.operators import traces


@pytest.mark.parametrize("within", [1, 7, 40, 1000])
def test_delays_and_false_changes(spark, within):
    rng = np.random.default_rng(within)
    changed = sorted({(int(r), int(t)) for r, t in zip(rng.integers(0, 3, 200), rng.integers(0, 900, 200))})
    drifts = sorted({(int(r), int(t)) for r, t in zip(rng.integers(0, 4, 25), rng.integers(0, 900, 25))})
    c = spark.createDataFrame([(r, t, t % 5) for r, t in changed], "run int, t long, rank int")
    d = spark.createDataFrame(drifts, "run int, drift long")
    got = {(r.run, r.drift): r.delay for r in traces.adaptation_delay(c, d, ["run"], within).collect()}
    want = {(r, x): min((t - x for q, t in changed if q == r and x <= t <= x + within), default=None) for r, x in drifts}
    assert got == want
    kept = traces.false_changes(c, d, ["run"], within)
    assert kept.columns == c.columns
    out = sorted((r.run, r.t) for r in kept.collect())
    assert out == [(r, t) for r, t in changed if not any(q == r and x <= t <= x + within for q, x in drifts)]


@pytest.mark.parametrize("span", [10, 5000, 1 << 20])
def test_recovery(spark, span):
    rng = np.random.default_rng(5)
    chunks = [(run, 10 * k, 10 * k + 10, float(np.round(rng.random() ** (3 if run else 1), 3)), ) for run in range(2) for k in range(3000)]
    drifts = [(run, 10 * int(k)) for run in range(3) for k in rng.integers(1, 3000, 12)] + [(0, 30_000), (1, 5)]
    drifts = sorted(set(drifts))
    c = spark.createDataFrame(chunks, "run int, start long, end long, score double")
    got = {(r.run, r.drift): (r.target, r.recovery) for r in traces.recovery(c, spark.createDataFrame(drifts, "run int, drift long"), ["run"], 0.99, span).collect()}
    assert len(got) == len(drifts)
    for run, drift in drifts:
        before = [s for r, _, e, s in chunks if r == run and e == drift]
        target = before[0] * 0.99 if before else None
        later = [e - drift for r, a, e, s in chunks if before and r == run and a >= drift and s >= target]
        assert got[run, drift] == (pytest.approx(target) if before else None, min(later, default=None))
