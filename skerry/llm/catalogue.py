"""Queries and oracle SQL of this subpackage's operators, for the driver's entry file."""

from __future__ import annotations

from skerry.llm import jaccard_join, language_id, license_scan, mixing, piece_codec, quality_classifier, quality_rules, sharding, token_counts, topk_search

MODULES = [license_scan, token_counts, piece_codec, mixing, topk_search, quality_rules, language_id, jaccard_join, sharding, quality_classifier]

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
