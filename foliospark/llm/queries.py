"""Queries of this package by name, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib

#: module and function of each query
_PLACES = {
    "op1_warc_revisits": "warc",
    "op2_media_columns": "media",
    "op3_simhash_near_dedup": "simhash",
    "op4_mix_sources": "mixing",
    "op5_compression_language": "langid",
    "op6_secret_scan": "secret_scan",
    "op7_license_scan": "licenses",
    "op8_exact_topk": "topk",
    "op9_toxicity": "toxicity",
    "op10_sentencepiece": "pieces",
    "op11_lexical_search": "lexical",
    "op12_superminhash_near_dedup": "superminhash",
    "op13_periodic_runs": "runs",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"foliospark.llm.{module}"), name) for name, module in _PLACES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"foliospark.llm.{module}"), "ORACLE_SQL", None) for name, module in _PLACES.items()}
    return {name: sql for name, sql in found.items() if sql}
