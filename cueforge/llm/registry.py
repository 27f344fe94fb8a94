"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import alignment, bpe, decontaminate, langid, lexical, lm, neardup, pages, quality, simhash, substrings, tokenfiles, unigram

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_minhash_near_dedup": neardup.op3_minhash_near_dedup,
    "op4_language_id": langid.op4_language_id,
    "op5_html_extraction": pages.op5_html_extraction,
    "op6_token_files": tokenfiles.op6_token_files,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_token_counts": unigram.op8_token_counts,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_lm_scoring": lm.op10_lm_scoring,
    "op11_simhash_near_dedup": simhash.op11_simhash_near_dedup,
    "op12_ranked_lexical_search": lexical.op12_ranked_lexical_search,
    "op13_cross_tokenizer_alignment": alignment.op13_cross_tokenizer_alignment,
}

ORACLE = {
    "op2_substring_dedup": substrings.OP2_SQL,
    "op3_minhash_near_dedup": neardup.OP3_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
    "op12_ranked_lexical_search": lexical.OP12_SQL,
}
