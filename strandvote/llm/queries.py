"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, decontamination, language_id, licenses, line_dedup, merkle, mixing, near_dedup, phrases, quality_classifier, quality_rules, sharding, surrogates

QUERIES = {
    "op1_bradley_terry_quality": quality_classifier.op1_bradley_terry_quality,
    "op2_winnow_lines": line_dedup.op2_winnow_lines,
    "op3_surrogates": surrogates.op3_surrogates,
    "op4_mix_source_weights": mixing.op4_mix_source_weights,
    "op5_bayes_minhash_dedup": near_dedup.op5_bayes_minhash_dedup,
    "op6_distribution_rules": quality_rules.op6_distribution_rules,
    "op7_license_templates": licenses.op7_license_templates,
    "op8_feistel_shards": sharding.op8_feistel_shards,
    "op9_cgk_decontamination": decontamination.op9_cgk_decontamination,
    "op10_bigru_language": language_id.op10_bigru_language,
    "op11_rabin_karp_phrases": phrases.op11_rabin_karp_phrases,
    "op12_bpe_trie": bpe.op12_bpe_trie,
    "op13_bitmap_rank_merkle": merkle.op13_bitmap_rank_merkle,
}

ORACLE_SQL = {
    "op4_mix_source_weights": mixing.OP4_SQL,
    "op8_feistel_shards": sharding.op8_sql(),
    "op11_rabin_karp_phrases": phrases.OP11_SQL,
    "op13_bitmap_rank_merkle": merkle.op13_sql(),
}
