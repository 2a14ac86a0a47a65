"""Registered queries over the driver tables and over literal fixtures, each with its SQL."""

from __future__ import annotations

from . import fixtures, flows, searches, tables  # searches and flows register with tables

__all__ = ["ORACLES", "QUERIES", "fixtures", "flows", "searches", "tables"]
QUERIES = {**tables.QUERIES, **fixtures.QUERIES}
ORACLES = {**tables.ORACLES, **fixtures.ORACLES}
