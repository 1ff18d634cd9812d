"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from sieveline.llm import ann, chat_format, decontaminate, language_id, line_dedup, ngram_join, piece_codec, quality, secret_scan, url_filter

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_ann": ann.op3_ann,
    "op4_language_id": language_id.op4_language_id,
    "op5_piece_codec": piece_codec.op5_piece_codec,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat_format.SQL,
    "op2_url_filter": url_filter.SQL,
    "op8_ngram_join": ngram_join.SQL,
    "op10_line_dedup": line_dedup.SQL,
}
