"""Names of the asset queries, with their functions and SQL."""

from __future__ import annotations


def queries() -> dict:
    from . import asset_queries

    return dict(asset_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import asset_sql

    return dict(asset_sql.SQL)
