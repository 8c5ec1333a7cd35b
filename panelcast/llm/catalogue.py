"""The queries of the operators and the SQL statements that check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import (
    op1_token_codes,
    op2_near_dups,
    op3_language,
    op4_repeats,
    op5_fingerprints,
    op6_mixing,
    op7_packing,
    op8_chat,
    op9_classifier,
    op10_quality,
    op11_merkle,
    op12_alignment,
    op13_toxicity,
)

MODULES = {
    "op1_token_codes": op1_token_codes,
    "op2_near_dups": op2_near_dups,
    "op3_language_id": op3_language,
    "op4_suffix_dedup": op4_repeats,
    "op5_fingerprints": op5_fingerprints,
    "op6_mixing": op6_mixing,
    "op7_packing": op7_packing,
    "op8_chat_format": op8_chat,
    "op9_quality_classifier": op9_classifier,
    "op10_quality_rules": op10_quality,
    "op11_merkle_manifest": op11_merkle,
    "op12_token_alignment": op12_alignment,
    "op13_toxicity": op13_toxicity,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: m.query for name, m in MODULES.items()}
ORACLES: dict[str, str] = {name: m.ORACLE for name, m in MODULES.items() if m.ORACLE}
