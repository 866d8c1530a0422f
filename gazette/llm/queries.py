"""The queries and SQL of this subpackage, as the entry module adds them."""

from __future__ import annotations

from . import decontamination, html_text, language_model, licenses, mixing, near_dedup, pii, prefix_trie, quality, sharding, token_files, topk, vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        sharding.op1_virtual_slot_sharding,
        decontamination.op2_benchmark_decontamination,
        quality.op3_fourier_quality_classifier,
        pii.op4_checked_pii,
        topk.op5_norm_sorted_topk,
        mixing.op6_hash_threshold_mixing,
        html_text.op7_layout_html_text,
        near_dedup.op8_setsketch_near_dedup,
        language_model.op9_pitman_yor_scores,
        licenses.op10_license_digests,
        token_files.op11_ranked_token_files,
        vector_codes.op12_va_file_codes,
        prefix_trie.op13_conversation_prefix_trie,
    )
}
#: Without SQL: 1 (crc32), 3, 7, 9 and 11.
ORACLE_SQL = {**decontamination.ORACLE, **pii.ORACLE, **topk.ORACLE, **mixing.ORACLE, **near_dedup.ORACLE, **licenses.ORACLE, **vector_codes.ORACLE, **prefix_trie.ORACLE}
