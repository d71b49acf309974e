"""Queries that SQL expresses against DuckDB; columns of all of them."""

import duckdb
import pytest

from driftloom.llm import queries

COLUMNS = {
    "op2_pareto_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_crf_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_count_min_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6_ftrl_quality": ["doc_id", "held_out", "score", "predicted"],
    "op7_hierarchical_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_ball_tree_topk": ["query_id", "rank", "vec_id", "score"],
    "op9_token_group_join": ["doc_id", "n_shingles", "component_id"],
    "op10_ring_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op11_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12_tokenizer_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op13_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = list(want.columns)
    key = lambda df: sorted(map(str, df[order].itertuples(index=False, name=None)))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
