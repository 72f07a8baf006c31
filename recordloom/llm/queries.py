"""The subpackage's queries and their SQL twins."""

from __future__ import annotations

from recordloom.llm import align, chat, langid, middle, mixing, neighbours, packing, secrets, simhash, sketches, suffixes, templates, topk

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_suffix_dedup": suffixes.op4_suffix_dedup,
    "op5_chat_perspectives": chat.op5_chat_perspectives,
    "op6_line_dedup": templates.op6_line_dedup,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_language_id": langid.op8_language_id,
    "op9_document_fingerprints": sketches.op9_document_fingerprints,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_tokenizer_alignment": align.op11_tokenizer_alignment,
    "op12_nearest_neighbours": neighbours.op12_nearest_neighbours,
    "op13_fill_in_middle": middle.op13_fill_in_middle,
}
ORACLES = {
    "op5_chat_perspectives": chat.ORACLE,
    "op7_exact_topk": topk.ORACLE,
    "op12_nearest_neighbours": neighbours.ORACLE,
    "op13_fill_in_middle": middle.ORACLE,
}
