"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from tamarack.queries import conversation, knowledge, replies, retrieval  # noqa: F401
from tamarack.queries.registry import QUERIES, SQL

FLAGSHIP = "hybrid_retrieval"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
