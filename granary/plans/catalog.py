"""Every query of the library outside the corpus-preparation package, with its SQL."""

from __future__ import annotations

from granary.plans import document_queries, search_queries, table_queries, text_queries
from granary.plans.base import Query

PARTS = (search_queries.C, text_queries.C, table_queries.C, document_queries.C)

flagship = search_queries.flagship


def queries() -> dict[str, Query]:
    return {name: f for part in PARTS for name, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.sql.items()}
