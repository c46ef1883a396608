"""Registered queries of the training-data operators and their DuckDB SQL, where SQL can express them."""

from creditlens.llm import (
    exact_dedup,
    line_dedup,
    lm_scoring,
    merkle,
    mixing,
    near_dedup,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    resampling,
    substring_dedup,
    tool_calls,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_pii_surrogates": pii.op2_pii_surrogates,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_mixing": mixing.op6_mixing,
    "op7_tool_calls": tool_calls.op7_tool_calls,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_packing": packing.op10_packing,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}

ORACLES = {
    "op7_tool_calls": tool_calls.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_importance_resampling": resampling.ORACLE,
}
