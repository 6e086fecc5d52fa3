"""Named query plans and their DuckDB oracles."""

from vitrine.plans import jobs, queries  # noqa: F401  (registers the queries)
from vitrine.plans.registry import QUERIES

__all__ = ["QUERIES"]
