"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from . import chat, collocations, decontaminate, exact_dedup, html_text, language, piece_bpe, pseudonyms, quality, simhash, spelling, substring_dedup, topk
from .oracles import ORACLES

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_language": language.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_html_text": html_text.query,
    "op6_pseudonyms": pseudonyms.query,
    "op7_chat": chat.query,
    "op8_piece_bpe": piece_bpe.query,
    "op9_quality": quality.query,
    "op10_simhash": simhash.query,
    "op11_spelling": spelling.query,
    "op12_collocations": collocations.query,
    "op13_top_k": topk.query,
}

__all__ = ["ORACLES", "QUERIES"]
