"""The queries of this subpackage by name, with SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from . import chat, clustering, decontaminate, licenses, near_dedup, neighbours, packing, pages, quality, sharding, substring_dedup, topk, trie

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_chat": chat.op2_chat,
    "op3_licenses": licenses.op3_licenses,
    "op4_packing": packing.op4_packing,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_pages": pages.op8_pages,
    "op9_quality": quality.op9_quality,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_centroids": clustering.op11_centroids,
    "op12_neighbours": neighbours.op12_neighbours,
    "op13_trie": trie.op13_trie,
}

ORACLE_SQL = {
    "op1_topk": topk.SQL,
    "op2_chat": chat.SQL,
    "op3_licenses": licenses.SQL,
    "op5_near_dedup": near_dedup.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_centroids": clustering.SQL,
    "op13_trie": trie.SQL,
}
