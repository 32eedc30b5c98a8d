"""Queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from parapet.llm import decontaminate, html_text, language_id, language_model, mixing, near_dup, quality_cnn, quality_rules, toxicity, warc


def queries() -> dict:
    return {
        "op1_html_text": html_text.query,
        "op2_quality_rules": quality_rules.query,
        "op3_toxicity": toxicity.query,
        "op4_warc": warc.query,
        "op5_suffix_tree": language_model.query,
        "op6_quality_cnn": quality_cnn.query,
        "op7_near_dup": near_dup.query,
        "op8_mixing": mixing.query,
        "op9_language_id": language_id.query,
        "op10_decontaminate": decontaminate.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": warc.ORACLE,
        "op7_near_dup": near_dup.ORACLE,
        "op8_mixing": mixing.ORACLE,
        "op10_decontaminate": decontaminate.ORACLE,
    }
