"""All queries over the given tables, by name, with the SQL that DuckDB checks them by."""

from __future__ import annotations

from fragloom.plans import decision_queries, fragment_queries, lookup_queries, store_queries, transfer_queries

MODULES = (fragment_queries, store_queries, decision_queries, transfer_queries, lookup_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: f for m in MODULES for name, f in m.ORACLES.items()}
FLAGSHIP = "canonical_dedup"
