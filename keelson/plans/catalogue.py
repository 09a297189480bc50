"""All queries by name, and their DuckDB SQL."""

from __future__ import annotations

from . import relational, tables

QUERIES = {**tables.QUERIES, **relational.QUERIES}
ORACLES = {**tables.ORACLES, **relational.ORACLES}
