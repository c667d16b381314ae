"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import exact_dedup, html_text, ngram_join, packing, piece_sampling, quality, secrets, substring_dedup, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_near_duplicates": ngram_join.op2_near_duplicates,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality": quality.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_html_text": html_text.op6_html_text,
    "op7_piece_sampling": piece_sampling.op7_piece_sampling,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}
ORACLES: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
}
