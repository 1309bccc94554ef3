"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from fragloom.llm import ann, decontamination, html_text, licenses, line_dedup, mixing, simhash, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_html_text": html_text.op5_html_text,
    "op6_licenses": licenses.op6_licenses,
    "op7_mixing": mixing.op7_mixing,
    "op8_simhash": simhash.op8_simhash,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_toxicity": toxicity.op10_toxicity,
    # what SQL can express of op6 and op7
    "license_base": licenses.license_base,
    "mix_targets": mixing.mix_targets,
}
ORACLES = {"op2_line_dedup": line_dedup.ORACLE_SQL, "license_base": licenses.BASE_SQL, "mix_targets": mixing.TARGETS_SQL}
