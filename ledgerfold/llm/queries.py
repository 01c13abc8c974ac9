"""All queries of this subpackage: QUERIES by name, and SQL for those that DuckDB can run."""

from __future__ import annotations

from . import queries_classifiers, queries_exact, queries_license, queries_near, queries_packing, queries_tokens, queries_warc

_MODULES = (queries_classifiers, queries_exact, queries_license, queries_near, queries_packing, queries_tokens, queries_warc)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
