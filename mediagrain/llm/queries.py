"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from mediagrain.llm import conversation_repair, decontaminate, language, line_dedup, manifest, near_dedup, packing, quality, repetition, shingle_join, substring_dedup, toxicity, urls


def queries() -> dict:
    return {
        "op1_url_filters": urls.op1,
        "op2_substring_dedup": substring_dedup.op2,
        "op3_packing": packing.op3,
        "op4_ngram_jaccard_join": shingle_join.op4,
        "op5_decontamination": decontaminate.op5,
        "op6_language_id": language.op6,
        "op7_repetition_rules": repetition.op7,
        "op8_quality_ranking": quality.op8,
        "op9_toxicity": toxicity.op9,
        "op10_line_dedup": line_dedup.op10,
        "op11_merkle_manifest": manifest.op11,
        "op12_conversation_repair": conversation_repair.op12,
        "op13_minhash_near_dedup": near_dedup.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_decontamination": decontaminate.SQL5,
        "op10_line_dedup": line_dedup.SQL10,
        "op11_merkle_manifest": manifest.SQL11,
        "op12_conversation_repair": conversation_repair.SQL12,
    }
