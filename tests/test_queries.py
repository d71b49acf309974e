"""Every registered query with SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from driftloom.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def tidy(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if pd.isna(x) else x for x in row) for row in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = tidy(got), tidy(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-6) if all(isinstance(v, (int, float)) for v in x) else x == y


@pytest.mark.parametrize("name", ["run_all_methods", "run_state_sizes", "method_registry", "streamed_trace"])
def test_kernel_queries_run(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_without_the_optional_part():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert entry._optional("no_such_module_here") is None
