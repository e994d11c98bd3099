"""Registered queries: each operator applied to the memory store, with SQL that must agree."""

from __future__ import annotations

from . import logs, relational, retrieval, sources, upkeep
from .registry import QUERIES, SQL

MODULES = (relational, retrieval, upkeep, logs, sources)


def flagship(spark, sf_dir):
    """Batch hybrid search over every query of the table."""
    return QUERIES["f12_hybrid_search"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
