"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import chat_format, decontamination, html_text, language_id, mixing, ngram_join, suffix_dedup, token_counts, topk_search, toxicity


def queries() -> dict:
    return {
        "op1_topk_search": topk_search.op1_topk_search,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_mixing": mixing.op5_mixing,
        "op6_language_id": language_id.op6_language_id,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_html_text": html_text.op8_html_text,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql() -> dict:
    return {
        "op1_topk_search": topk_search.OP1_SQL,
        "op4_chat_format": chat_format.OP4_SQL,
        "op5_mixing": mixing.OP5_SQL,
        "op9_ngram_join": ngram_join.OP9_SQL,
        "op10_suffix_dedup": suffix_dedup.OP10_SQL,
    }
