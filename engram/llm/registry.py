"""Queries and SQL of the training-data operators, for the entry module."""

from __future__ import annotations

from . import chat, decontaminate, langid, line_dedup, ngram_join, packing, pii, quality_model, quality_rules, url_filter

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_pii": pii.op6_pii,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_quality_classifier": quality_model.op9_quality_classifier,
    "op10_language_id": langid.op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.OP1_SQL,
    "op2_chat_formatting": chat.OP2_SQL,
    "op3_url_filters": url_filter.OP3_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_benchmark_decontamination": decontaminate.OP7_SQL,
}
