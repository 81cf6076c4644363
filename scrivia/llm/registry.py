"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrivia.llm import conversation_repair, jaccard_join, langid, lexical_search, mixing, packing, piece_bpe, quality, token_count, token_files, top_k_search, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_url_filters": url_filter.op1_url_filters,
        "op2_sentencepiece": piece_bpe.op2_sentencepiece,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_token_files": token_files.op5_token_files,
        "op6_source_mixing": mixing.op6_source_mixing,
        "op7_top_k_search": top_k_search.op7_top_k_search,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_token_counts": token_count.op9_token_counts,
        "op10_language_id": langid.op10_language_id,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_ranked_search": lexical_search.op12_ranked_search,
        "op13_best_fit_packing": packing.op13_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filter.OP1_SQL,
        "op6_source_mixing": mixing.OP6_SQL,
        "op7_top_k_search": top_k_search.OP7_SQL,
        "op8_quality_rules": quality.OP8_SQL,
        "op11_conversation_repair": conversation_repair.OP11_SQL,
        "op12_ranked_search": lexical_search.OP12_SQL,
    }
