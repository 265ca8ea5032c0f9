"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_secret_scans": "secrets", "op2_suffix_dedup": "suffixes", "op3_decontamination": "decontamination", "op4_jaccard_join": "jaccard", "op5_packing": "packing",
    "op6_url_filters": "urls", "op7_toxicity": "toxicity", "op8_embedding_dedup": "embeddings", "op9_license_scans": "licenses", "op10_lm_scoring": "language_model",
    "op11_bpe": "bpe", "op12_source_divergence": "divergence", "op13_conversations": "conversations",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"lodestone.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: importlib.import_module(f"lodestone.llm.{module}") for name, module in _MODULES.items()}
    return {name: m.oracle() for name, m in found.items() if hasattr(m, "oracle")}
