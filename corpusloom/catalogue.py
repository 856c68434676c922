"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from corpusloom.plans import events, extraction, graph, layers, models, people, retrieval, roundtrips, state, text  # noqa: F401  they register their queries
from corpusloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
