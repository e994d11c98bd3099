"""Liveness predicates over transaction time and event time. All take times in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def live() -> Column:
    return F.col("invalidated_ms").isNull()


def as_of(t: int) -> Column:
    """Known at ``t``: created by then and not yet invalidated."""
    return (F.col("created_ms") <= t) & (F.col("invalidated_ms").isNull() | (F.col("invalidated_ms") > t))


def edge_as_of(t: int) -> Column:
    return (F.col("valid_from_ms") <= t) & (F.col("invalidated_ms").isNull() | (F.col("invalidated_ms") > t))


def valid_at(t: int) -> Column:
    """True at ``t`` in event time; a window that was never claimed is always valid."""
    return (F.col("event_from_ms").isNull() | (F.col("event_from_ms") <= t)) & (F.col("event_to_ms").isNull() | (F.col("event_to_ms") > t))


def active_since(now: int, ttl_days: int = 7, history: bool = False, as_of: int | None = None, kinds: tuple[str, ...] = ()) -> int | None:
    """The start of episodic activity; None turns the predicate off, 0 only drops what is distilled."""
    if history or as_of is not None or kinds == ("episodic",):
        return None
    return now - ttl_days * 86_400_000 if ttl_days else 0


def active_episodic(since: int | None) -> Column:
    if since is None:
        return F.lit(True)
    return (F.col("memory_kind") != "episodic") | (F.col("consolidated_ms").isNull() & (F.col("created_ms") >= since))


def authored() -> Column:
    return F.col("memory_kind").isin("semantic", "episodic")


def project_family(project: Column) -> Column:
    return F.split_part(project, F.lit("-"), F.lit(1))


def same_family(a: Column, b: Column) -> Column:
    """Projects of one family; null matches any."""
    return a.isNull() | b.isNull() | (project_family(a) == project_family(b))
