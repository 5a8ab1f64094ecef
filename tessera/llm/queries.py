"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

import importlib

#: Module -> its queries; each module has QUERIES (name -> function of spark, sf_dir) and may have ORACLE_SQL (name -> DuckDB SQL).
MODULES = ("q_dedup", "q_chat", "q_embed", "q_secrets", "q_media", "q_packing", "q_langid", "q_license", "q_mixing", "q_lm")


def _gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"tessera.llm.{name}"), attribute, {})
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
