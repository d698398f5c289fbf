"""Registered queries of the journey operators and their oracle SQL."""

from __future__ import annotations

from trailmark.plans import clusters, contracts, delivery, intake, journeys, testing

_PLANS = (journeys, clusters, intake, contracts, testing, delivery)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
