"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import ann, classifier, contentsort, html, linededup, lm, media, mixing, packing, resample, rollup, simhash, trie

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_packed_windows": packing.op2_packed_windows,
    "op3_media_columns": media.op3_media_columns,
    "op4_template_free_text": html.op4_template_free_text,
    "op5_ctw_scores": lm.op5_ctw_scores,
    "op6_token_rollup": rollup.op6_token_rollup,
    "op7_posting_list_neighbours": ann.op7_posting_list_neighbours,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_simhash_components": simhash.op9_simhash_components,
    "op10_site_quality": classifier.op10_site_quality,
    "op11_content_sort": contentsort.op11_content_sort,
    "op12_target_resampling": resample.op12_target_resampling,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLE_SQL = {
    "op1_source_mix": mixing.SQL,
    "op8_line_dedup": linededup.SQL,
    "op11_content_sort": contentsort.SQL,
    "op12_target_resampling": resample.SQL,
    "op13_prefix_trie": trie.SQL,
}
