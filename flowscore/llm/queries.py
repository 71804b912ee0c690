"""The registered queries of this subpackage and the SQL that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: query name -> operator module
MODULES = {
    "op1_suffix_dedup": "op1_suffix_dedup",
    "op2_quality_rules": "op2_quality_rules",
    "op3_warc": "op3_warc",
    "op4_decontaminate": "op4_decontaminate",
    "op5_site_bayes": "op5_site_bayes",
    "op6_pitman_yor": "op6_pitman_yor",
    "op7_license_scan": "op7_license_scan",
    "op8_ngram_join": "op8_ngram_join",
    "op9_line_dedup": "op9_line_dedup",
    "op10_mix_sources": "op10_mix_sources",
    "op11_url_filter": "op11_url_filter",
    "op12_embedding_whitening": "op12_embedding_whitening",
    "op13_periodic_runs": "op13_periodic_runs",
}

_MODULES = {name: import_module(f"flowscore.llm.{module}") for name, module in MODULES.items()}
QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLE = {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
