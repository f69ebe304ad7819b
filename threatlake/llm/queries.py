"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Query and its module.
MODULES = {
    "op1_token_counts": "token_counts",
    "op2_lm_scoring": "language_model",
    "op3_ngram_join": "ngram_join",
    "op4_embedding_near_dedup": "near_vectors",
    "op5_license_scan": "licenses",
    "op6_document_fingerprints": "fingerprints",
    "op7_pii": "pii",
    "op8_best_fit_packing": "packing",
    "op9_sentencepiece": "piece_sampling",
    "op10_language_id": "language_id",
    "op11_importance_resampling": "importance",
    "op12_token_alignment": "token_alignment",
    "op13_secret_scan": "secret_scan",
}


def queries() -> dict[str, Callable]:
    return {name: getattr(importlib.import_module(f"threatlake.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"threatlake.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
