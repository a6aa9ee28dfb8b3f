"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Query names by module.
_MODULES = {
    "op1_near_dedup": "near_dedup",
    "op2_sharding": "sharding",
    "op3_toxicity": "toxicity",
    "op4_bpe": "bpe",
    "op5_mixing": "mixing",
    "op6_exact_dedup": "exact_dedup",
    "op7_warc": "warc",
    "op8_language": "language",
    "op9_quality": "quality",
    "op10_topk": "topk",
}


def queries() -> dict:
    import corpus_pipeline

    return {name: importlib.import_module(f"verbarium.llm.{m}").query for name, m in _MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"verbarium.llm.{m}"), "SQL", None) for name, m in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
