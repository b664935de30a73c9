"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from veritab.llm import decontamination, hard_negatives, language_id, manifest, mixing, near_duplicates, oracle, packing, personal_data, quality_rules, telephony, tokens, warc, weak_quality

QUERIES = {
    "op1_weak_quality": weak_quality.op1_weak_quality,
    "op2_telephony_audio": telephony.op2_telephony_audio,
    "op3_personal_data": personal_data.op3_personal_data,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_near_duplicates": near_duplicates.op5_near_duplicates,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_warc": warc.op7_warc,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_mixing": mixing.op9_mixing,
    "op10_language_id": language_id.op10_language_id,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

#: The others need hashing, learning or packing that SQL can't express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_warc": oracle.warc(),
    "op8_quality_rules": oracle.quality_rules(),
    "op11_decontamination": oracle.decontamination(),
    "op12_merkle_manifest": oracle.manifest(),
    "op13_hard_negatives": oracle.hard_negatives(),
}
