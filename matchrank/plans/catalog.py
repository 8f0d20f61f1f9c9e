"""Registered queries over the reference's own operators and their DuckDB twins."""

from __future__ import annotations

from matchrank.plans import inventory_queries, rank_queries, retrieval_queries, text_queries

MODULES = (text_queries, rank_queries, retrieval_queries, inventory_queries)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLES.items()}
