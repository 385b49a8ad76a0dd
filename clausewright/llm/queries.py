"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import byte_bpe, conversation_repair, decontaminate, exact_dedup, language_id, licenses, ngram_join, pii, sharding, substring_dedup, toxicity, tree_join, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_language_id": language_id.op3_language_id,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_ngram_jaccard_join": ngram_join.op5_ngram_jaccard_join,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pii": pii.op7_pii,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_warc": warc.op9_warc,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_sharding": sharding.op11_sharding,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_hot_key_join": tree_join.op13_hot_key_join,
}
SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_license_scan": licenses.SQL,
    "op5_ngram_jaccard_join": ngram_join.SQL,
    "op8_decontamination": decontaminate.SQL,
    "op9_warc": warc.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_sharding": sharding.SQL,
    "op13_hot_key_join": tree_join.SQL,
}
