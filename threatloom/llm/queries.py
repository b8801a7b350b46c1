"""Query name -> function of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_line_dedup": "line_dedup",
    "op2_warc": "warc",
    "op3_token_shards": "token_shards",
    "op4_decontaminate": "decontaminate",
    "op5_packing": "packing",
    "op6_rule_ensemble": "rule_ensemble",
    "op7_simhash": "simhash",
    "op8_secrets": "secrets",
    "op9_toxicity": "toxicity",
    "op10_quality_rules": "quality_rules",
    "op11_conversation_repair": "conversation_repair",
    "op12_url_filters": "url_filters",
    "op13_filter_audit": "filter_audit",
}
_loaded = {name: importlib.import_module(f"threatloom.llm.{module}") for name, module in _MODULES.items()}

QUERIES = {name: module.query for name, module in _loaded.items()}
ORACLES = {name: module.SQL for name, module in _loaded.items() if hasattr(module, "SQL")}
