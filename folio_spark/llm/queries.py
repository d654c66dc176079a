"""Registered queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from folio_spark.llm import op1_html, op2_embedding, op3_toxicity, op4_repeats, op5_decontaminate, op6_jaccard, op7_bpe, op8_license, op9_katz, op10_chat, op11_merkle, op12_resample, op13_pii

QUERIES = {
    "op1_html_text": op1_html.op1_html_text,
    "op2_embedding_dedup": op2_embedding.op2_embedding_dedup,
    "op3_toxicity": op3_toxicity.op3_toxicity,
    "op4_suffix_repeats": op4_repeats.op4_suffix_repeats,
    "op5_decontaminate": op5_decontaminate.op5_decontaminate,
    "op6_jaccard_join": op6_jaccard.op6_jaccard_join,
    "op7_byte_bpe": op7_bpe.op7_byte_bpe,
    "op8_license_scan": op8_license.op8_license_scan,
    "op9_katz_lm": op9_katz.op9_katz_lm,
    "op10_chat_format": op10_chat.op10_chat_format,
    "op11_merkle_manifest": op11_merkle.op11_merkle_manifest,
    "op12_importance_resample": op12_resample.op12_importance_resample,
    "op13_private_spans": op13_pii.op13_private_spans,
}

ORACLES = {
    "op2_embedding_dedup": op2_embedding.SQL,
    "op6_jaccard_join": op6_jaccard.SQL,
    "op10_chat_format": op10_chat.SQL,
    "op11_merkle_manifest": op11_merkle.SQL,
    "op12_importance_resample": op12_resample.SQL,
}
