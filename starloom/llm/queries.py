"""The registered text queries and the SQL that checks them, where SQL can say it."""

from __future__ import annotations

import importlib

#: (module, query, name of its SQL or None)
ENTRIES = [
    ("toxicity", "op1_toxicity", None),
    ("token_store", "op8_token_store", None),
    ("line_dedup", "op2_line_dedup", "OP2_SQL"),
    ("quality_model", "op7_quality_model", None),
    ("sharding", "op10_sharding", None),
    ("mixing", "op6_mixing", "OP6_SQL"),
    ("secrets", "op3_secrets", None),
    ("neardup", "op4_minhash_near_dedup", None),
    ("decontamination", "op5_decontamination", None),
    ("quality_rules", "op9_quality_rules", None),
    ("alignment", "op11_tokenizer_alignment", None),
    ("bitplanes", "op12_centroid_clustering", "OP12_SQL"),
    ("licenses", "op13_license_scan", None),
]


def queries() -> dict:
    return {q: getattr(importlib.import_module(f"starloom.llm.{m}"), q) for m, q, _ in ENTRIES}


def oracle_sql() -> dict:
    return {q: getattr(importlib.import_module(f"starloom.llm.{m}"), s) for m, q, s in ENTRIES if s}
