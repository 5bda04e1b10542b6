"""Registry of this subpackage's driver queries and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module that holds it.
MODULES = {
    "op1_norm_bucket_top_k": "top_k",
    "op2_token_files": "token_files",
    "op3_local_parsing": "fingerprints",
    "op4_best_fit_packing": "packing",
    "op5_longest_match_counts": "token_counts",
    "op6_crf_language_id": "language_id",
    "op7_nbest_segmentation": "nbest_pieces",
    "op8_link_graph_filter": "url_filter",
    "op9_hierarchical_quality": "quality",
    "op10_dart_minhash": "near_duplicates",
    "op11_line_dedup": "line_dedup",
    "op12_centroid_clusters": "centroids",
    "op13_wavelet_search": "wavelet_search",
}
#: Query name -> module whose ORACLE_SQL expresses it.
SQL_MODULES = {"op1_norm_bucket_top_k": "top_k", "op8_link_graph_filter": "url_filter", "op11_line_dedup": "line_dedup", "op12_centroid_clusters": "centroids", "op13_wavelet_search": "wavelet_search"}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"{__package__}.{module}").ORACLE_SQL for name, module in SQL_MODULES.items()}
