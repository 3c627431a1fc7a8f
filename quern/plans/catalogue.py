"""Every query that the driver runs, with the SQL it is checked against."""

from __future__ import annotations

from quern.plans import cleaning, intents, modelling, quality, relational, runs, scoring, surface  # noqa: F401
from quern.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
