"""Queries by name, and the SQL that gives the same rows."""

from . import queries, queries_cases, queries_documents, queries_gates, queries_space

_MODULES = (queries, queries_cases, queries_space, queries_documents, queries_gates)
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}

__all__ = ["QUERIES", "SQL"]
