"""The registered queries of this subpackage, with SQL where SQL can express one."""

from __future__ import annotations

from importlib import import_module

from tidelog.llm import jaccard, near_vectors, repeats, url_filter

#: Query: module. Each module holds a function of the query's name.
MODULES = {
    "op1_mixing": "mixing",
    "op2_url_filter": "url_filter",
    "op3_secret_scan": "secret_scan",
    "op4_near_vectors": "near_vectors",
    "op5_quality": "quality",
    "op6_packing": "packing",
    "op7_repeats": "repeats",
    "op8_jaccard": "jaccard",
    "op9_html_text": "html_text",
    "op10_nearest": "nearest",
}


def queries() -> dict:
    """Name to callable(spark, sf_dir)."""
    return {name: getattr(import_module(f"tidelog.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {"op2_url_filter": url_filter.ORACLE, "op4_near_vectors": near_vectors.ORACLE, "op7_repeats": repeats.ORACLE, "op8_jaccard": jaccard.oracle(4, 85)}
