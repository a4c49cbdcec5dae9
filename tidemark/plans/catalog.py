"""Every query over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from . import queries_accounts, queries_composed, queries_discovery, queries_events, queries_runs, queries_scalar, queries_tables  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
