"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from rowkin.llm import corpus_queries, record_queries, text_queries

QUERIES = {**record_queries.QUERIES, **text_queries.QUERIES, **corpus_queries.QUERIES}
ORACLES = {**record_queries.ORACLES, **text_queries.ORACLES, **corpus_queries.ORACLES}
