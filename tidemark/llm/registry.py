"""Queries of the training-data operators and their SQL equivalents, by name."""

from __future__ import annotations

from tidemark.llm import chosen_path, exact_dedup, flac, language, mixing, packing, quality, substring_dedup, token_counts, url_filters

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1,
    "op2_token_counts": token_counts.op2,
    "op3_packing": packing.op3,
    "op4_mixing": mixing.op4,
    "op5_language": language.op5,
    "op6_flac": flac.op6,
    "op7_quality": quality.op7,
    "op8_chosen_path": chosen_path.op8,
    "op9_substring_dedup": substring_dedup.op9,
    "op10_url_filters": url_filters.op10,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op8_chosen_path": chosen_path.OP8_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op10_url_filters": url_filters.OP10_SQL,
}
