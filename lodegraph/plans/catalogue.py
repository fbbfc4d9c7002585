"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from . import answer_queries, audit_queries, claim_queries, event_queries, filing_queries, graph_queries, name_queries, person_queries, product_queries, rank_queries, record_queries, segment_queries, spread_queries, stream_queries, title_queries, vector_queries  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
