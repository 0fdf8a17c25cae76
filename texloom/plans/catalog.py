"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from . import corpus_queries, corpus_state_queries, entity_queries, memory_queries, place_queries, report_queries, scholar_queries, search_queries  # noqa: F401  (they register)
from . import listing_queries  # noqa: F401  (after those whose SQL it uses)
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "bm25_with_labels"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
