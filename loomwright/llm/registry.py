"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, jaccard, language_model, lines, mixing, quality, substrings, tokens, urls

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_quality_rules": quality.op2,
    "op3_lm_score": language_model.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_line_dedup": lines.op5,
    "op6_url_filter": urls.op6,
    "op7_substring_dedup": substrings.op7,
    "op8_token_files": tokens.op8,
    "op9_jaccard_join": jaccard.op9,
    "op10_chat_format": chat.op10,
}
ORACLES = {"op1_mix_sources": mixing.SQL, "op2_quality_rules": quality.SQL, "op10_chat_format": chat.SQL}
