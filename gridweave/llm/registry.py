"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from gridweave.llm import chat, chunk_dedup, grid_codes, html_crf, language_id, matroska, mixing, ngram_join, packing, quality_rules, shard_tree, url_filter, whitening

QUERIES = {
    "op1_chat_rotation": chat.op1_chat_rotation,
    "op2_mixing": mixing.op2_mixing,
    "op3_matroska": matroska.op3_matroska,
    "op4_language_id": language_id.op4_language_id,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_chunk_dedup": chunk_dedup.op6_chunk_dedup,
    "op7_shard_tree": shard_tree.op7_shard_tree,
    "op8_packing": packing.op8_packing,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_html_crf": html_crf.op11_html_crf,
    "op12_whitening": whitening.op12_whitening,
    "op13_grid_codes": grid_codes.op13_grid_codes,
}

SQL = {
    "op1_chat_rotation": chat.OP1_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op6_chunk_dedup": chunk_dedup.OP6_SQL,
    "op13_grid_codes": grid_codes.OP13_SQL,
}
