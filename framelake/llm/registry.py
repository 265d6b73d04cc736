"""Queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import best_fit, conversation_repair, exact_dedup, language_model, lexical_search, license_scan, line_dedup, mixing, near_dedup, packing, token_files, topk_search, toxicity

_OPS = [packing.op1_packing, language_model.op2_language_model, license_scan.op3_license_scan, toxicity.op4_toxicity, topk_search.op5_topk_search, exact_dedup.op6_exact_dedup, near_dedup.op7_near_dedup, line_dedup.op8_line_dedup, token_files.op9_token_files, mixing.op10_mixing, best_fit.op11_best_fit, conversation_repair.op12_conversation_repair, lexical_search.op13_lexical_search]
QUERIES = {f.__name__: f for f in _OPS}
ORACLES = exact_dedup.ORACLE | topk_search.ORACLE | line_dedup.ORACLE | conversation_repair.ORACLE | lexical_search.ORACLE
