"""All registered queries of the market research operators."""

from __future__ import annotations

from . import cross_queries, curation_queries, event_queries, extra_queries, research_queries, signal_queries, source_queries, stream_queries, window_queries

_MODULES = (
    cross_queries,
    curation_queries,
    event_queries,
    extra_queries,
    research_queries,
    signal_queries,
    source_queries,
    stream_queries,
    window_queries
)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
FLAGSHIP = "agg05_mom_decile_summary"
