"""All queries outside the llm subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from strandflow.plans import queries_composite, queries_core, queries_defects, queries_detect, queries_edits, queries_events, queries_evidence, queries_lifetime, queries_material, queries_network, queries_phase

MODULES = (queries_core, queries_detect, queries_network, queries_material, queries_phase, queries_composite, queries_events, queries_defects, queries_edits, queries_evidence, queries_lifetime)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
