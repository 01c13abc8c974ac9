"""The registered queries of the library: QUERIES by name, and SQL for those that DuckDB can run."""

from __future__ import annotations

from .plans import evidence, kv, tables

FLAGSHIP = "q_and"
_MODULES = (kv, tables, evidence)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
