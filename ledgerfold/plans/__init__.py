"""Registered queries, each with the same in DuckDB's SQL."""
