"""The queries of this subpackage, by name."""

from __future__ import annotations

from lodestar.llm import alignment, context_tree, fingerprint, language_id, lexical_search, line_dedup, near_dedup, packing, pii, quality_rules, secret_scan, segment_sampling, toxicity

MODULES = [quality_rules, packing, secret_scan, line_dedup, language_id, segment_sampling, context_tree, fingerprint, near_dedup, pii, toxicity, lexical_search, alignment]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
