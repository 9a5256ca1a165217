"""Named queries over the standard tables, each with a SQL oracle where SQL can express it."""

from tessellon.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
