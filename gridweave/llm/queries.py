"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import cost_packing, decontamination, exact_dedup, language, merkle, near_dedup, ngram_trie, packing, substring_dedup, url_filter, variants, warc, wavelet

QUERIES = {
    "op1_wavelet_tokens": wavelet.op1,
    "op2_ngram_trie": ngram_trie.op2,
    "op3_near_dedup": near_dedup.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_substring_dedup": substring_dedup.op5,
    "op6_warc": warc.op6,
    "op7_best_fit_packing": packing.op7,
    "op8_language": language.op8,
    "op9_decontamination": decontamination.op9,
    "op10_url_filter": url_filter.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_spelling_variants": variants.op12,
    "op13_cost_packing": cost_packing.op13,
    # parts of op2 and op10 that SQL can express
    "base_scores": ngram_trie.base_scores,
    "url_rules": url_filter.ruled,
}
ORACLES = {
    "op3_near_dedup": near_dedup.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op6_warc": warc.SQL,
    "op9_decontamination": decontamination.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_spelling_variants": variants.SQL,
    "base_scores": ngram_trie.BASE_SQL,
    "url_rules": url_filter.RULED_SQL,
}
