"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import html_text, language_model, mixing, near_duplicates, nearest, packing, quality_rules, token_counts, token_files, url_filters

_MODULES = {
    "op1_language_model": language_model,
    "op2_token_counts": token_counts,
    "op3_html_text": html_text,
    "op4_token_files": token_files,
    "op5_nearest": nearest,
    "op6_mixing": mixing,
    "op7_packing": packing,
    "op8_near_duplicates": near_duplicates,
    "op9_url_filters": url_filters,
    "op10_quality_rules": quality_rules,
}
QUERIES = {name: module.query for name, module in _MODULES.items()}
#: Modules without ORACLE have no SQL form; their tests hold them against brute force.
ORACLES = {name: module.ORACLE for name, module in _MODULES.items() if hasattr(module, "ORACLE")}
