"""The registered queries and their SQL."""

from __future__ import annotations

from lodestone.plans import analytics, bodies, entities, fixtures, functions, ingest, joins, monitor, observations  # noqa: F401
from lodestone.plans.base import QUERIES, SQL, adapt, with_views


def queries() -> dict:
    return {name: adapt(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql, *views) for name, (sql, views) in SQL.items()}
