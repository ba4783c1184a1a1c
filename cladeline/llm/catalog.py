"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, divergence, html_extraction, jaccard_join, lexical_search, media, mixing, packing, quality, sharding, suffix_dedup, top_k, url_filters


def queries() -> dict:
    return {
        "op1_html_extraction": html_extraction.op1_html_extraction,
        "op2_sharding": sharding.op2_sharding,
        "op3_mixing": mixing.op3_mixing,
        "op4_quality": quality.op4_quality,
        "op5_url_filters": url_filters.op5_url_filters,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_packing": packing.op7_packing,
        "op8_nearest_neighbours": ann.op8_nearest_neighbours,
        "op9_top_k": top_k.op9_top_k,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_media_columns": media.op11_media_columns,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }


def oracle_sql() -> dict:
    return {
        "op5_url_filters": url_filters.OP5_SQL,
        "op6_suffix_dedup": suffix_dedup.OP6_SQL,
        "op9_top_k": top_k.OP9_SQL,
        "op10_jaccard_join": jaccard_join.OP10_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
        "op13_lexical_search": lexical_search.OP13_SQL,
    }
