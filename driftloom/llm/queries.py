"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment,
    jaccard_join,
    langid,
    mixing,
    packing,
    periodic,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    token_files,
    topk,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.query,
    "op2_pareto_mixing": mixing.query,
    "op3_crf_toxicity": toxicity.query,
    "op4_count_min_substrings": substring_dedup.query,
    "op5_quality_rules": quality_rules.query,
    "op6_ftrl_quality": quality_classifier.query,
    "op7_hierarchical_langid": langid.query,
    "op8_ball_tree_topk": topk.query,
    "op9_token_group_join": jaccard_join.query,
    "op10_ring_sharding": sharding.query,
    "op11_periodic_runs": periodic.query,
    "op12_tokenizer_alignment": alignment.query,
    "op13_token_files": token_files.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_pareto_mixing": mixing.ORACLE_SQL,
    "op4_count_min_substrings": substring_dedup.ORACLE_SQL,
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op8_ball_tree_topk": topk.ORACLE_SQL,
    "op9_token_group_join": jaccard_join.ORACLE_SQL,
}
