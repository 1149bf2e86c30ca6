"""Every registered query of the survey engine, with its oracle SQL."""

from __future__ import annotations

from tidemark.plans import dataset, evaluation, files, ground, inventory, lookups, polygons, records, reports, review, singles, spatial, stats  # noqa: F401  they register their queries
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
