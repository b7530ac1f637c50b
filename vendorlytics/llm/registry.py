"""The operators' queries and their DuckDB oracles."""

from __future__ import annotations

import importlib

MODULES = ["op1_mixing", "op2_pii", "op3_urls", "op4_lines", "op5_jaccard", "op6_quality",
           "op7_topk", "op8_passages", "op9_embeddings", "op10_bpe", "op11_merkle", "op12_phrases", "op13_wrappers"]


def _collect(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"vendorlytics.llm.{name}"), kind))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
