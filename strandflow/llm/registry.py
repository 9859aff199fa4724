"""All queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from strandflow.llm import queries_docs, queries_index, queries_models, queries_native, queries_search

MODULES = (queries_native, queries_docs, queries_index, queries_models, queries_search)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
