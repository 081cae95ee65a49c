"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: query name -> (module, function)
_WHERE = {
    "op1_weighted_sampling": "fingerprint",
    "op10_chosen_path_join": "join",
    "op11_jacobi_whitening": "whitening",
    "op12_phrase_mining": "phrases",
    "op13_odd_sketches": "oddsketch",
    "op2_fuzzy_lines": "lines",
    "op3_transducer_counts": "tokencount",
    "op4_dominance_packing": "packing",
    "op5_crf_language": "langid",
    "op6_histogram_sort": "sharding",
    "op7_decision_list": "quality",
    "op8_agenda_pieces": "pieces",
    "op9_budgeted_windows": "chat",
}


def queries() -> dict:
    import corpus_pipeline

    return {n: getattr(importlib.import_module(f".{m}", __package__), n) for n, m in _WHERE.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {}
