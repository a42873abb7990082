"""The queries of this subpackage, by their registered names, and the SQL of those that have one."""

from __future__ import annotations

import importlib

#: Registered name to module.
MODULES = {
    "op4_best_fit_packing": "packing",
    "op5_token_files": "tokens",
    "op1_lm_scores": "lm",
    "op2_near_duplicates": "dedup",
    "op3_topk_search": "topk",
    "op6_language_id": "langid",
    "op7_quality_rules": "quality",
    "op8_secret_scans": "secrets",
    "op9_license_scans": "licenses",
    "op10_source_mixing": "mixing",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: _module(name).SQL for name in MODULES if getattr(_module(name), "SQL", None)}
