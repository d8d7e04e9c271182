"""The training-data queries and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

import importlib

#: Query name: (module, function).
NAMES = {
    "op1_ctw_score": ("ctw", "op1_ctw_score"),
    "op2_ann_search": ("ann", "op2_ann_search"),
    "op3_line_dedup": ("lines", "op3_line_dedup"),
    "op4_bpe": ("bpe", "op4_bpe"),
    "op5_extract_html": ("html", "op5_extract_html"),
    "op6_topk_search": ("topk", "op6_topk_search"),
    "op7_repeated_passages": ("repeats", "op7_repeated_passages"),
    "op8_jaccard_join": ("jaccard", "op8_jaccard_join"),
    "op9_mix_sources": ("mixing", "op9_mix_sources"),
    "op10_language_id": ("language", "op10_language_id"),
    "op11_fill_in_middle": ("fim", "op11_fill_in_middle"),
    "op12_merkle_manifest": ("merkle", "op12_merkle_manifest"),
    "op13_license_scan": ("licenses", "op13_license_scan"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tidelog.llm.{module}"), function) for name, (module, function) in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    from . import fim, jaccard, lines, merkle, repeats, topk

    return {"op11_fill_in_middle": fim.OP11_SQL, "op12_merkle_manifest": merkle.OP12_SQL, "op3_line_dedup": lines.OP3_SQL, "op6_topk_search": topk.OP6_SQL, "op7_repeated_passages": repeats.OP7_SQL, "op8_jaccard_join": jaccard.OP8_SQL}
