"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airshed.llm import (
    chat_format, decontaminate, exact_dedup, html_text, jaccard_join, piece_bpe, pitman_yor, quality, spelling, substring_dedup, token_align, toxicity, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_sentencepiece": piece_bpe.op4_sentencepiece,
    "op5_pitman_yor": pitman_yor.op5_pitman_yor,
    "op6_quality": quality.op6_quality,
    "op7_html_text": html_text.op7_html_text,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_spelling": spelling.op11_spelling,
    "op12_chat_format": chat_format.op12_chat_format,
    "op13_token_align": token_align.op13_token_align,
}

ORACLES: dict[str, str] = {
    "op1_jaccard_join": jaccard_join.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op3_url_filter": url_filter.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_spelling": spelling.SQL,
    "op12_chat_format": chat_format.SQL,
}
