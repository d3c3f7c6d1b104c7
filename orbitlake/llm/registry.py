"""The queries of this folder."""

from __future__ import annotations

from collections.abc import Callable

from orbitlake.llm import decontamination, hard_negatives, html_text, licenses, lm_scoring, mixing, near_dedup, prefix_trie, quality_model, quality_rules, sharding, substring_dedup, warc


def queries() -> dict[str, Callable]:
    found = [
        mixing.op1_mixing,
        quality_model.op2_quality_model,
        licenses.op3_licenses,
        decontamination.op4_decontamination,
        near_dedup.op5_near_dedup,
        lm_scoring.op6_lm_scoring,
        sharding.op7_sharding,
        html_text.op8_html_text,
        substring_dedup.op9_substring_dedup,
        quality_rules.op10_quality_rules,
        hard_negatives.op11_hard_negatives,
        warc.op12_warc,
        prefix_trie.op13_prefix_trie,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": hard_negatives.SQL, "op12_warc": warc.SQL, "op13_prefix_trie": prefix_trie.SQL}
