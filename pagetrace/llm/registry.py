"""Registered queries of this package: name -> (function, oracle SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ["warc", "token_store", "toxic_spans", "simhash", "byte_bpe", "mixing", "quality", "embedding_dedup", "personal_data", "vector_search", "decontamination", "importance", "lexical_search"]


def registered() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"pagetrace.llm.{name}").QUERIES
    return found
