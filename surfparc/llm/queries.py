"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from surfparc.llm import chat, decontaminate, jaccard, langid, licenses, packing, quality, repair, runs, sharding, suffix, topk, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix.op1_suffix_dedup,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_quality": quality.op5_quality,
    "op6_sharding": sharding.op6_sharding,
    "op7_packing": packing.op7_packing,
    "op8_exact_top_k": topk.op8_exact_top_k,
    "op9_language_id": langid.op9_language_id,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLES = {
    "op3_license_scan": licenses.ORACLE,
    "op4_decontamination": decontaminate.ORACLE,
    "op8_exact_top_k": topk.ORACLE,
    "op10_chat_formatting": chat.ORACLE,
    "op11_conversation_repair": repair.ORACLE,
}
