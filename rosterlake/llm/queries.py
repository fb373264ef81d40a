"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from rosterlake.llm import (
    adaptive_scan,
    bpe_automaton,
    collocations,
    conversation_repair,
    embedding_dedup,
    language_id,
    license_scan,
    ngram_join,
    personal_data,
    source_mix,
    substring_lines,
    suffix_dedup,
    toxicity,
)

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_adaptive_scan": adaptive_scan.op3_adaptive_scan,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_bpe": bpe_automaton.op5_bpe,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_source_mix": source_mix.op7_source_mix,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_line_dedup": substring_lines.op10_line_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_collocations": collocations.op12_collocations,
    "op13_personal_data": personal_data.op13_personal_data,
}

ORACLE = {
    "op1_embedding_dedup": embedding_dedup.ORACLE,
    "op6_ngram_join": ngram_join.ORACLE,
    "op9_license_scan": license_scan.ORACLE,
    "op10_line_dedup": substring_lines.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_personal_data": personal_data.ORACLE,
}
