"""Operators of a training-data pipeline; nothing else here imports them.

Modules are imported when queries are asked for, not with the package: tasks
import single modules, and each worker would otherwise hold all of them.
"""

from __future__ import annotations


def _modules() -> tuple:
    from . import chat, conversation_trie, decontaminate, exact_dedup, jaccard_join, license_scan, line_dedup, media, mixing, pieces, pii, toxicity, vector_codes

    return toxicity, pii, pieces, mixing, jaccard_join, exact_dedup, media, chat, license_scan, line_dedup, conversation_trie, decontaminate, vector_codes


def queries() -> dict:
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
