"""Queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import ann, decontamination, jaccard_join, language_id, line_dedup, minmax_dedup, packing, ranked_search, spelling_variants, suffix_dedup, token_counts, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_token_files": token_files.op4_token_files,
        "op5_language_id": language_id.op5_language_id,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_collision_counting": ann.op8_collision_counting,
        "op9_minmax_near_dedup": minmax_dedup.op9_minmax_near_dedup,
        "op10_benchmark_decontamination": decontamination.op10_benchmark_decontamination,
        "op11_spelling_variants": spelling_variants.op11_spelling_variants,
        "op12_jaccard_join": jaccard_join.op12_jaccard_join,
        "op13_windowed_search": ranked_search.op13_windowed_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": line_dedup.OP6_SQL, "op10_benchmark_decontamination": decontamination.OP10_SQL, "op11_spelling_variants": spelling_variants.OP11_SQL, "op12_jaccard_join": jaccard_join.OP12_SQL, "op13_windowed_search": ranked_search.OP13_SQL}
