"""Registered queries of this package and, where SQL can say the same, their DuckDB statements."""

from __future__ import annotations

from importlib import import_module

#: module -> query; a module's ORACLE is the statement of its query.
MODULES = {
    "decontamination": "op1_decontamination",
    "secret_links": "op2_secret_links",
    "block_topk": "op3_block_topk",
    "jaccard_groups": "op4_jaccard_groups",
    "suffix_dedup": "op5_suffix_dedup",
    "bpe": "op6_bpe",
    "quality": "op7_quality",
    "line_dedup": "op8_line_dedup",
    "ppm": "op9_ppm",
    "sharding": "op10_sharding",
    "html_content": "op11_html_content",
    "whitening": "op12_whitening",
    "importance": "op13_importance",
}


def queries():
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for module, name in MODULES.items()}


def oracle_sql():
    return {name: sql for module, name in MODULES.items() if (sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE", None))}
