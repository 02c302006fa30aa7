"""The queries of this subpackage and their SQL. Queries without SQL are held against brute force in tests/llm."""

from __future__ import annotations

from . import chat, decontaminate, jaccard, language, licenses, line_templates, mixing, token_files, topk, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_chat_perspectives": chat.op3_chat_perspectives,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_language_id": language.op5_language_id,
    "op6_top_k": topk.op6_top_k,
    "op7_token_files": token_files.op7_token_files,
    "op8_warc_derivatives": warc.op8_warc_derivatives,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_line_templates": line_templates.op10_line_templates,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op3_chat_perspectives": chat.ORACLE,
    "op4_ngram_jaccard": jaccard.ORACLE,
    "op6_top_k": topk.ORACLE,
    "op8_warc_derivatives": warc.ORACLE,
    "op9_license_scan": licenses.ORACLE,
}
