"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, embeddings, lines, mixing, pages, periodic, quality, rules, search, simhash, substrings, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_substring_dedup": substrings.op2_substring_dedup,
        "op3_embedding_dedup": embeddings.op3_embedding_dedup,
        "op4_main_text": pages.op4_main_text,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_token_counts": tokens.op8_token_counts,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_simhash": simhash.op10_simhash,
        "op11_quality_rules": rules.op11_quality_rules,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_ranked_search": search.op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substrings.OP2_SQL,
        "op7_mix_sources": mixing.OP7_SQL,
        "op9_decontaminate": decontaminate.OP9_SQL,
        "op10_simhash": simhash.OP10_SQL,
        "op11_quality_rules": rules.OP11_SQL,
        "op12_periodic_runs": periodic.OP12_SQL,
        "op13_ranked_search": search.OP13_SQL,
    }
