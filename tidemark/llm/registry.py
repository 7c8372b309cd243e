"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import chat, conversations, decontamination, exact_dedup, html_text, importance, language_id, licences, merkle, packing, sanitise, simhash, token_scan

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_sum_of_squares_packing,
        sanitise.op2_information_theoretic_sanitisation,
        importance.op3_importance_resampling,
        language_id.op4_bidirectional_gru_language,
        licences.op5_sentence_rule_licences,
        html_text.op6_composite_text_density,
        decontamination.op7_aho_corasick_decontamination,
        simhash.op8_segment_popcount_simhash,
        exact_dedup.op9_perfect_hash_dedup,
        token_scan.op10_separator_scan,
        conversations.op11_conversation_structure_repair,
        chat.op12_reply_tree_formatting,
        merkle.op13_merkle_manifest,
    )
}
ORACLE_SQL = decontamination.ORACLE_SQL | exact_dedup.ORACLE_SQL | licences.ORACLE_SQL | conversations.ORACLE_SQL | chat.ORACLE_SQL | merkle.ORACLE_SQL
