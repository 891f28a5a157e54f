"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, dedup, lm, mixing, ngram_join, packing, pii, token_counts, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": mixing.op1_source_mixing,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_exact_topk": topk.op4_exact_topk,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_pii": pii.op7_pii,
        "op8_lm_scoring": lm.op8_lm_scoring,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_exact_dedup": dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_topk": topk.OP4_SQL, "op5_chat_formatting": chat.OP5_SQL, "op10_exact_dedup": dedup.OP10_SQL}
