"""Exact quantiles against NumPy, for many groups at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators.quantiles import exact_quantiles, from_bits, ordered_bits

SHARES = [0.0, 0.1, 0.5, 0.8, 0.95, 1.0]


def test_bits_keep_order_and_come_back(spark):
    x = [-np.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 3e300, np.inf]
    got = spark.createDataFrame([(float(v),) for v in x], "v double").select("v", ordered_bits("v").alias("b")).withColumn("back", from_bits("b")).collect()
    bits = [r.b for r in got]
    assert bits == sorted(bits) and bits[4] == bits[5] and len(set(bits)) == len(x) - 1
    assert [r.back for r in got] == [r.v + 0.0 for r in got]


def test_many_groups(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=700), "b": rng.integers(-3, 3, 400).astype(float), None: rng.lognormal(0, 30, 301), "one": np.array([4.5]), "two": np.array([-1.0, 1e-9])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {(r.g, r.share): r.quantile for r in exact_quantiles(df, ["g"], F.col("v"), SHARES).collect()}
    assert set(got) == {(g, s) for g in groups for s in SHARES}
    for (g, s), q in got.items():
        assert q == pytest.approx(np.quantile(groups[g], s), rel=1e-12, abs=1e-12)


def test_one_group_and_none(spark):
    df = spark.range(1001).select((F.col("id") * 5 % 1001).cast("double").alias("v"))
    assert {r.share: r.quantile for r in exact_quantiles(df, [], F.col("v"), [0.25, 0.5]).collect()} == {0.25: 250.0, 0.5: 500.0}
    assert exact_quantiles(df.limit(0), [], F.col("v"), [0.5]).count() == 0
