"""Registries of queries over the engine's operators, and the SQL that states what each returns."""

from __future__ import annotations

from crawlframe.plans import crawl_queries, function_queries, service_queries, state_queries, storage_queries  # noqa: F401  they register their queries
from crawlframe.plans.registry import FOUND, SQL


def queries():
    return dict(FOUND)


def oracle_sql():
    return dict(SQL)
