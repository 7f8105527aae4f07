"""The queries that SQL can express, for DuckDB."""

from __future__ import annotations

ORACLES: dict[str, str] = {}
