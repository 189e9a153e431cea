"""The registered corpus queries and their SQL."""

from __future__ import annotations

from dnslens.llm import bpe, chat, decontamination, divergence, fingerprints, licences, lines, near, packing, repair, substrings, toxicity, urls

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_document_fingerprints": fingerprints.op3_document_fingerprints,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_license_scans": licences.op5_license_scans,
    "op6_benchmark_decontamination": decontamination.op6_benchmark_decontamination,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_minhash_near_dedup": near.op8_minhash_near_dedup,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_url_filters": urls.op10_url_filters,
    "op11_source_divergence_audit": divergence.op11_source_divergence_audit,
    "op12_conversation_structure_repair": repair.op12_conversation_structure_repair,
    "op13_best_fit_packing": packing.op13_best_fit_packing,
}
ORACLES = {
    "op1_line_dedup": lines.SQL,
    "op5_license_scans": licences.SQL,
    "op4_chat_formatting": chat.SQL,
    "op8_minhash_near_dedup": near.SQL,
    "op9_substring_dedup": substrings.SQL,
    "op10_url_filters": urls.SQL,
    "op11_source_divergence_audit": divergence.SQL,
    "op12_conversation_structure_repair": repair.SQL,
}
