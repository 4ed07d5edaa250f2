"""Every engine query by name, and the SQL that states the same result."""

from __future__ import annotations

from tessera.plans import ledger_queries, search_queries, stream_queries, text_queries

_PARTS = (ledger_queries, text_queries, search_queries, stream_queries)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLE.items()}
