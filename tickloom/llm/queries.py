"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Module of each operator's query.
QUERIES = {
    "op1_line_dedup": "lines",
    "op2_arc_to_warc": "warc",
    "op3_secret_scan": "secrets",
    "op4_decontaminate": "decontaminate",
    "op5_token_records": "token_records",
    "op6_chat_format": "chat",
    "op7_ngram_jaccard": "jaccard",
    "op8_fingerprints": "fingerprints",
    "op9_sentencepiece": "pieces",
    "op10_language_id": "langid",
    "op11_vector_codes": "vector_codes",
    "op12_filter_audit": "filter_audit",
    "op13_minhash": "minhash",
}
#: Those that SQL can express have it as SQL in their module.
WITH_SQL = ["op11_vector_codes", "op12_filter_audit"]


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tickloom.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: importlib.import_module(f"tickloom.llm.{QUERIES[name]}").SQL for name in WITH_SQL}
