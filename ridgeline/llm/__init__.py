"""Corpus preparation for language-model training. Nothing else in the library imports this subpackage."""

from ridgeline.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
