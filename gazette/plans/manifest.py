"""Every registered query of the feed engine and its SQL."""

from __future__ import annotations

from gazette.plans import feed_queries, page_queries, scalar_queries, text_queries, topic_queries

_MODULES = (feed_queries, text_queries, topic_queries, scalar_queries, page_queries)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
entry = topic_queries.flagship
