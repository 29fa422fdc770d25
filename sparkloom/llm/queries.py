"""The registered queries of this package."""

from __future__ import annotations

from . import chat_format, fingerprints, jaccard_join, mixing, packing, pii, quality_rules, secret_scan, token_counts, toxicity

_MODULES = (mixing, toxicity, fingerprints, jaccard_join, token_counts, packing, chat_format, secret_scan, quality_rules, pii)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
