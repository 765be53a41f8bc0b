"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES = {
    "op1_substring_dedup": "substring_dedup",
    "op2_embedding_dedup": "embedding_dedup",
    "op3_lm_scoring": "lm_scoring",
    "op4_html_extraction": "html_extract",
    "op5_exact_dedup": "exact_dedup",
    "op6_best_fit_packing": "packing",
    "op7_simhash_dedup": "simhash_dedup",
    "op8_quality_classifier": "quality",
    "op9_secret_scan": "secrets",
    "op10_sentencepiece": "sentencepiece_codec",
    "op11_warc": "warc",
    "op12_prefix_trie": "prefix_trie",
    "op13_ranked_search": "ranked_search",
}
_SQL = {"op2_embedding_dedup": ("embedding_dedup", "OP2_SQL"), "op3_lm_scoring": ("lm_scoring", "OP3_SQL"), "op5_exact_dedup": ("exact_dedup", "OP5_SQL"), "op11_warc": ("warc", "OP11_SQL"), "op12_prefix_trie": ("prefix_trie", "OP12_SQL"), "op13_ranked_search": ("ranked_search", "OP13_SQL")}


def _of(module: str, name: str):
    return getattr(importlib.import_module(f"{__package__}.{module}"), name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name and function of each query, called with (spark, sf_dir)."""
    return {name: _of(module, name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {name: _of(*where) for name, where in _SQL.items()}
