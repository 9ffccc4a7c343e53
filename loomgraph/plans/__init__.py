"""Queries of the corpus-graph engine, with SQL that gives the same rows."""
from __future__ import annotations

from . import document_queries, graph_queries, table_queries, vector_queries

_PARTS = (vector_queries.R, graph_queries.R, document_queries.R, table_queries.R)
QUERIES = {k: q for r in _PARTS for k, q in r.queries.items()}
ORACLES = {k: s for r in _PARTS for k, s in r.oracles.items()}
