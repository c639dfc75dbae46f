"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from defectflow.llm import collocations, conversations, decontamination, html_text, language_id, licenses, mixing, pii, quality, simhash, substring_dedup, token_counts, token_files

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality_rules, html_text.op2_html_text, substring_dedup.op3_substring_dedup, simhash.op4_simhash, licenses.op5_license_scan,
        decontamination.op6_decontamination, token_counts.op7_token_counts, pii.op8_pii, token_files.op9_token_files, mixing.op10_mixing,
        language_id.op11_language_id, conversations.op12_conversations, collocations.op13_collocations,
    )
}
ORACLE_SQL = {"op1_quality_rules": quality.OP1_SQL, "op13_collocations": collocations.OP13_SQL}
