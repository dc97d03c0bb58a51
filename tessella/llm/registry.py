"""The operators' queries and, where SQL can express one, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, line_dedup, ngram_join, packing, pseudonyms, quality_model, quality_rules, sharding, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality_model.query,
    "op2_toxicity": toxicity.query,
    "op3_best_fit_packing": packing.query,
    "op4_sharding": sharding.query,
    "op5_ngram_join": ngram_join.query,
    "op6_token_counts": token_counts.query,
    "op7_decontamination": decontaminate.query,
    "op8_quality_rules": quality_rules.query,
    "op9_pseudonyms": pseudonyms.query,
    "op10_line_dedup": line_dedup.query,
}

SQL: dict[str, str] = {"op10_line_dedup": line_dedup.SQL}
