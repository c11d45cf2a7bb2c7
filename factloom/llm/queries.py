"""The queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, filter_audit, language_id, licenses, lm_score, secrets, simhash, suffix_dedup, target_resample, token_counts, token_files

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_token_files": token_files.op2_token_files,
    "op3_language_id": language_id.op3_language_id,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_secrets": secrets.op7_secrets,
    "op8_licenses": licenses.op8_licenses,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_target_resample": target_resample.op12_target_resample,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}

ORACLE_SQL = {
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
}
