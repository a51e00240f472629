"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib

#: query -> module of this subpackage that holds it
QUERIES = {
    "op1_line_dedup": "lines",
    "op2_simhash_near_dedup": "simhash",
    "op3_byte_bpe": "bpe",
    "op4_document_fingerprints": "winnow",
    "op5_toxicity": "toxicity",
    "op6_substring_dedup": "substrings",
    "op7_quality_classifier": "quality",
    "op8_html_extraction": "html",
    "op9_benchmark_decontamination": "decontaminate",
    "op10_chat_formatting": "chat",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tempograph.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"tempograph.llm.{module}"), "ORACLE_SQL", None) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
